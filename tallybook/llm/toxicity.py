"""Toxicity of whole texts: obfuscated words are restored first, then a trained sparse model scores the words."""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallybook.llm import deobfuscate as O
from tallybook.llm import texts as X
from tallybook.llm.sampling import at_most
from tallybook.llm.sparse import fit, sigmoid

#: The model learns from at most so many labelled rows of either class, chosen by a hash of their id.
TOXIC_ROWS, CLEAN_ROWS = 2000, 3000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7)
_CACHED = 100_000
#: ASCII letters small, ASCII punctuation and control signs to spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_set(text: bytes) -> set[bytes]:
    return set(text.translate(_PLAIN).split())


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings (marked by a dash)."""
    return [word, *(word[:n] + b"-" for n in PREFIXES if len(word) > n)]


class _Counts:
    """Feature counts of rows of words, made anew whenever they are read."""

    def __init__(self, rows: list[bytes]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self) -> Iterator[Counter]:
        return (Counter(f for w in row.split() for f in features(w)) for row in self.rows)


class _Weights(dict):
    """Word -> sum of its features' weights, worked out once."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > _CACHED:
            self.clear()
        out = self[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return out


def held_out(doc_id: str | Column) -> Column:
    """Rows that labels are never learned from; rows without an id among them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _restored(batch: pa.RecordBatch, restorer: O.Restorer, rows: int = 128) -> Iterator[tuple[bytes, int]]:
    """Text and number of decoded spans of each row; a few rows at a time, as the search for marks takes many times their room."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        data, offsets = X.buffer(pa.Table.from_batches([part]), "__text")
        odd = O.suspicious(data, offsets)
        raw = data.tobytes()
        for i in range(part.num_rows):
            text = raw[offsets[i]:offsets[i + 1]]
            if odd[i]:
                plain, n = restorer.restore(text.decode("utf-8", "replace"))
                yield plain.encode("utf-8", "replace"), n
            else:
                yield text, 0


def _training_rows(docs: DataFrame, labels: DataFrame, letters) -> tuple[list[tuple[int, bytes]], dict[int, float]]:
    marked = (labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
              .where(~held_out("doc_id")))
    total = {r["__toxic"]: r["count"] for r in marked.groupBy("__toxic").count().collect()}
    chosen = [at_most(marked.where(F.col("__toxic") == t), n, total.get(t, 0), "doc_id") for t, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = O.Restorer(letters.value)
        for b in batches:
            words = [b" ".join(sorted(word_set(t))) for t, _ in _restored(b, own)]
            yield pa.RecordBatch.from_arrays([b.column("__toxic"), pa.array(words, pa.binary())], ["toxic", "words"])
    found = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")     # at most TOXIC_ROWS + CLEAN_ROWS
             .select("__toxic", "__text").mapInArrow(run, "toxic int, words binary"))
    rows = sorted((r.toxic, bytes(r.words)) for r in found.collect())
    have = Counter(t for t, _ in rows)
    return rows, {t: total[t] / n for t, n in have.items()}


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``toxic_score`` (0 to 1) and ``n_restored`` (spans that were decoded) to the rows of docs; all columns and rows stay.

    The letter model is counted over all texts; the word model is trained on at most TOXIC_ROWS + CLEAN_ROWS labelled rows outside the
    held-out fold. Only the text decides a score. Null and empty texts get the score of a text without words. If several labels
    name a document, the toxic one counts; without labels of both kinds, every score is the share of toxic ones (0 for none). Equal texts have equal scores. Texts of any length are
    scored whole; one must fit in a task. Empty in, empty out.
    """
    names = ("toxic_score", "n_restored")
    rest = docs.drop(*names)
    context = docs.sparkSession.sparkContext
    letters = context.broadcast(O.language_model(O.letter_counts(docs)))                  # N**3 numbers
    rows, weight = _training_rows(docs, labels, letters)
    weights, bias = fit(_Counts([w for _, w in rows]), [t for t, _ in rows], [weight[t] for t, _ in rows], evidence=True) if len(weight) == 2 else ({}, 30.0 if 1 in weight else -30.0)
    model = context.broadcast((weights, bias))                                            # features of a bounded sample
    schema = T.StructType(list(rest.schema.fields)).add("toxic_score", "double").add("n_restored", "integer")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, base = model.value
        own, of = O.Restorer(letters.value), _Weights(found)
        for b in batches:
            scores, spans = [], []
            for text, n in _restored(b, own):
                x = base + sum(map(of.__getitem__, word_set(text)))
                scores.append(sigmoid(x))
                spans.append(n)
            made = {"toxic_score": pa.array(scores, pa.float64()), "n_restored": pa.array(spans, pa.int32())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b.column(f.name) for f in arrow], schema=arrow)
    return rest.withColumn("__text", F.coalesce("text", F.lit(""))).mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"),
                         (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: toxic documents go.

    All columns and the other rows stay, repeated ones and those without doc_id too; null and empty texts are scored like texts without words. Empty in, empty out.
    """
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where(F.col("toxic_score") < THRESHOLD).select(*docs.columns)
