"""Licence scans: a trained paragraph classifier, confirmed by comparison with the family's notices.

One sparse logistic regression on words and word pairs for each family, fitted to changed copies of the usual notices against paragraphs
of the corpus and sentences that only sound like licences. Scores are calibrated on copies kept out of the fit, so that a paragraph can be
of no family: the probability that no family reaches. A prediction is confirmed if the paragraph and a notice of the family share
their five-word shingles.
"""
from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallybook.llm.licence_notices import NO_FAMILY, NOTICES
from tallybook.llm.sampling import at_most
from tallybook.llm.sparse import calibrated, fit, sigmoid

#: Paragraphs of the corpus that stand for "no licence" in the fit come from at most so many documents, and are at most so many.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 300, 2000
COPIES = 16             # changed copies of each notice; every fourth calibrates
LIKELY = 0.5
SHINGLE, ALIKE = 5, 0.8
#: Paragraphs end at line breaks.
BREAK = "\n"
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.-][a-z0-9]+)*")

Found = tuple[int, str, float, float, bool]      # paragraph, family, probability, likeness, confirmed


def words(text: str | bytes) -> list[bytes]:
    return _WORD.findall((text.encode() if isinstance(text, str) else text).lower())


def grams(w: list[bytes]) -> Counter:
    return Counter([*w, *(a + b" " + b for a, b in zip(w, w[1:]))])


def shingles(w: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


class Classifier:
    """Weights of all families. ``corpus``: paragraphs without a licence."""

    def __init__(self, corpus: list[str], notices: dict[str, tuple[str, ...]] = NOTICES, seed: int = 1):
        rng = random.Random(seed)
        fillers = [w for p in corpus[:200] for w in words(p)] or [b"the"]
        rows: list[tuple[Counter, str | None, bool]] = []
        for family, texts in notices.items():
            for t in texts:
                for k in range(COPIES):
                    w = [x for x in words(t) if k == 0 or rng.random() > 0.08] or words(t)
                    if k % 2:
                        w = rng.choices(fillers, k=rng.randrange(12)) + w + rng.choices(fillers, k=rng.randrange(12))
                    rows.append((grams(w), family, k % 4 == 3))
        for t in NO_FAMILY:
            rows += [(grams([x for x in words(t) if k == 0 or rng.random() > 0.08]), None, k % 4 == 3) for k in range(COPIES)]
        rows += [(grams(words(p)), None, k % 4 == 3) for k, p in enumerate(corpus)]
        train, rest = [r for r in rows if not r[2]], [r for r in rows if r[2]]
        self.families, self.models = sorted(notices), {}
        for family in self.families:
            y = [int(f == family) for _, f, _ in train]
            share = [0.5 / sum(y) if v else 0.5 / (len(y) - sum(y)) for v in y]
            weights, bias = fit([g for g, _, _ in train], y, share, penalty=1e-3, steps=150, least=3, most=1.0)
            scores = [bias + sum(weights.get(f, 0.0) for f in g) for g, _, _ in rest]
            self.models[family] = (weights, bias, *calibrated(scores, [int(f == family) for _, f, _ in rest]))
        self.marks = {w for weights, *_ in self.models.values() for f, x in weights.items() if x > 0 for w in f.split()}
        self.notices = {f: [shingles(words(t)) for t in texts] for f, texts in notices.items()}

    def likely(self, w: list[bytes]) -> tuple[str, float]:
        """The likeliest family and its probability; what is left of 1 is the probability of none of them."""
        own = grams(w).keys()
        best, high = self.families[0], -1.0
        for family, (weights, bias, slope, offset) in self.models.items():
            p = sigmoid(slope * (bias + sum(weights[f] for f in own & weights.keys())) + offset)
            if p > high:
                best, high = family, p
        return best, high

    def likeness(self, w: list[bytes], family: str) -> float:
        """Largest share of a notice's shingles in the paragraph, or of the paragraph's in a notice."""
        own = shingles(w)
        return max((max(len(own & n) / len(n), len(own & n) / len(own)) for n in self.notices[family]), default=0.0) if own else 0.0

    def scan(self, text: str) -> tuple[int, list[Found]]:
        """Number of paragraphs that hold words, and those that name a licence."""
        paragraphs = text.split(BREAK)
        found, n = [], 0
        for i, p in enumerate(paragraphs):
            if not p or p.isspace():
                continue
            n += 1
            w = words(p)
            if self.marks.isdisjoint(w):               # no mark of any family: every score is at most its intercept's
                continue
            family, p1 = self.likely(w)
            if p1 >= LIKELY:
                alike = self.likeness(w, family)
                found.append((i, family, p1, alike, alike >= ALIKE))
        return n, found


def sampled_paragraphs(docs: DataFrame) -> list[str]:
    """At most SAMPLE_PARAGRAPHS paragraphs of SAMPLE_DOCS documents, chosen by hash, none of which speaks of a licence."""
    some = at_most(docs.where("text is not null").select("doc_id", "text"), SAMPLE_DOCS, docs.count(), "doc_id", "text")
    parts = some.select(F.explode(F.split("text", BREAK)).alias("p")).where("trim(p) != '' and not p rlike '(?i)licen[cs]e|copyright|rights reserved|public domain'")
    return [r.p for r in parts.distinct().orderBy(F.xxhash64("p"), "p").limit(SAMPLE_PARAGRAPHS).collect()]


def scan(docs: DataFrame) -> DataFrame:
    """Adds ``n_paragraphs`` and ``licences`` (paragraph, family, probability, likeness, confirmed) to the rows of docs.

    All rows and other columns stay; columns that have these names are replaced. Null and empty texts have no paragraphs. A paragraph names one family,
    the first by name where probabilities tie. Texts of any length are scanned whole; one must fit in a task. Equal texts have equal finds. Empty in, empty out.
    """
    rest = docs.drop("n_paragraphs", "licences")
    model = docs.sparkSession.sparkContext.broadcast(Classifier(sampled_paragraphs(docs)))        # bounded by the notices and the sample
    kind = T.StructType().add("paragraph", "integer").add("family", "string").add("probability", "double").add("likeness", "double").add("confirmed", "boolean")
    schema = T.StructType(list(rest.schema.fields)).add("n_paragraphs", "long").add("licences", T.ArrayType(kind))
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [model.value.scan(t.as_py() or "") for t in b.column("text")]
            new = {"n_paragraphs": pa.array([n for n, _ in made], pa.int64()),
                   "licences": pa.array([[dict(zip(names, f, strict=True)) for f in found] for _, found in made], arrow.field("licences").type)}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else b.column(f.name) for f in arrow], schema=arrow)
    return rest.mapInArrow(run, schema)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sure = F.filter("licences", lambda x: x["confirmed"])
    return found.select("doc_id", "n_paragraphs", F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
                        F.size(sure).cast("bigint").alias("n_confirmed"), (F.size("licences") - F.size(sure)).cast("bigint").alias("n_unconfirmed"),
                        F.coalesce(F.array_max(F.transform("licences", lambda x: x["probability"])), F.lit(0.0)).alias("probability"), "licences")
