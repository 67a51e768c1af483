"""Ranked lexical search by NRA: impact-sorted lists are read in order, and each document has an interval for its score.

The documents' terms that some item asks for are written once, with their counts. A task takes its documents in shards; within a shard each term has
a list of documents, the greatest impact first. For an item the lists of its terms are read side by side, a stretch at a time. What a document was
seen with is the lower end of its score; the upper end adds the impact that each list in which it was not seen has reached. A document is out when its upper
end lies below the score of the k-th one. Reading ends when no unseen document can come in and the interval of every document that
is left has closed: then places, ties and scores are exact. The k best of the shards make the k best of all.
"""
from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.llm import texts as X
from tallybook.operators.ordering import exclusive_prefix
from tallybook.session import stored

BEST = 10
FLAGS = 1 << 19             # a term is written if the flag of its checksum is set by some item's term; the ranking itself compares terms
BLOCK_TERMS = 1 << 18       # terms of items that are ranked in one pass
SHARD = 1 << 20             # postings that a task sorts at a time
STRETCH = 512               # of each list, read at first; then four times as much
#: ASCII letters in lower case, digits and all bytes beyond ASCII stay; the rest parts terms.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[list[bytes]]:
    """Terms of each row, with repeats."""
    data, offsets = X.buffer(batch, name)
    data = data.tobytes().translate(_PLAIN)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b].split()


def _lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for v in values for x in v], kind))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sorted(set(t)) for t in terms_of(b)]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), _lists(found, pa.binary())], ["item_id", "terms"])


def _counted(flags: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, last = zlib.crc32, FLAGS - 1
        for b in batches:
            n, terms, times = [], [], []
            for t in terms_of(b):
                n.append(len(t))
                found = [(term, c) for term, c in Counter(t).items() if flags[crc(term) & last]]
                terms.append([f[0] for f in found])
                times.append([f[1] for f in found])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(n, pa.int64()), _lists(terms, pa.binary()), _lists(times, pa.int64())],
                                             ["row", "doc_id", "n", "terms", "times"])
    return run


class Shard:
    """Impact-sorted lists of some documents: for term number t, ``docs`` and ``impacts`` from ``first[t]`` up to ``first[t + 1]``."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, times: np.ndarray, m: np.ndarray, weights: np.ndarray):
        impact = weights[term] * (1_000_000_000 * times // (1000 * times + 8 * m[doc]))
        order = np.lexsort((-impact, term))
        self.docs, self.impacts = doc[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.n = len(m)

    def best(self, terms: np.ndarray, k: int, least: int, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents with a score of ``least`` or more that can be among the k best, ties included, their scores, and how many postings were read."""
        lists = [(self.docs[a:z], self.impacts[a:z]) for a, z in zip(self.first[terms], self.first[terms + 1], strict=True) if z > a]
        lower = np.zeros(self.n, np.int64)
        read, to = 0, min(stretch, max((len(d) for d, _ in lists), default=0))
        while True:
            for docs, impacts in lists:
                lower[docs[read:to]] += impacts[read:to]
            reached = [int(impacts[to]) if len(impacts) > to else 0 for _, impacts in lists]
            ahead = sum(reached)
            bar = max(least, 1, int(np.partition(lower, -k)[-k]) if self.n >= k else 0)
            if ahead < bar:                                     # a document not seen at all stays below the bar
                gap = np.full(self.n, ahead)
                for (docs, _), r in zip(lists, reached, strict=True):
                    if r:
                        gap[docs[:to]] -= r
                left = lower + gap >= bar
                if not gap[left].any():
                    break
            read, to = to, 4 * to
        found = np.flatnonzero(lower >= bar)
        return found, lower[found], sum(min(to, len(d)) for d, _ in lists)


def _ranked(terms: list[bytes], weights: np.ndarray, items: list[tuple], n_docs: int, n_terms: int, k: int):
    """Top k of each item among the documents of one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.binary())
        asked = [np.asarray(a, np.int64) for _, a in items]
        best = [[] for _ in items]
        waiting, size = [], 0

        def rank() -> None:
            term, doc, times, n, ids, rows = (np.concatenate(x) for x in zip(*waiting, strict=True))
            shard = Shard(term, doc, times, 10 + 90 * n * n_docs // n_terms, weights)
            for i, a in enumerate(asked):
                at, score, _ = shard.best(a, k, -best[i][-1][0] if len(best[i]) == k else 0)
                if len(at):
                    best[i] = sorted(best[i] + list(zip((-score).tolist(), ids[at].tolist(), rows[at].tolist(), strict=True)))[:k]
            waiting.clear()
        docs = 0
        for b in batches:
            lists = b.column("terms")
            where = pc.index_in(lists.flatten(), value_set=known)
            lengths = np.diff(lists.offsets.to_numpy())
            some = where.is_valid().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(b.num_rows), lengths)[some] + docs
            waiting.append((where.drop_null().to_numpy().astype(np.int64), doc, b.column("times").flatten().to_numpy()[some], b.column("n").to_numpy(), X.ids(b, "doc_id"), b.column("row").to_numpy()))
            size, docs = size + len(doc), docs + b.num_rows
            if size >= SHARD or docs >= SHARD:
                rank()
                size = docs = 0
        if waiting:
            rank()
        out = [(items[i][0], doc_id if doc_id != X.NO_ID else None, row, -score, i) for i, found in enumerate(best) for score, doc_id, row in found]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["item_id", "doc_id", "row", "score", "item"])
    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of (doc_id, text) with the highest score above 0 for each item of (item_id, text).

    A null text, like one without terms, finds nothing and is not found. Each row of docs is a document of its own, also if id or text repeat; rows without
    doc_id come last among equal scores. Equal items are one, and different texts under one item_id are ranked one by one. Texts of any length are whole; a document
    must fit in a task. Other columns are dropped. Either table empty: nothing. Items are ranked in blocks of about ``block_terms`` terms, each against all documents.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct().mapInArrow(_item_terms, "item_id long, terms array<binary>")
    asked = stored(asked.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()))
    flags = np.zeros(FLAGS, np.uint8)
    marks = asked.select(F.explode("terms").alias("term")).select(F.pmod(F.crc32("term"), F.lit(FLAGS)).alias("at")).distinct().toArrow().column("at").to_numpy()   # FLAGS at most
    flags[marks] = 1
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    index = stored(texts.mapInArrow(_counted(flags.tobytes()), "row long, doc_id long, n long, terms array<binary>, times array<bigint>").where("n > 0"))
    total = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    sizes = asked.select("item", F.size("terms").cast("bigint").alias("n")).withColumn("range", F.shiftright("item", 16))
    sizes = exclusive_prefix(sizes, [], ["range", "item"], "n", "before") if asked.count() else sizes.withColumn("before", F.lit(0))
    asked = stored(asked.join(sizes.select("item", F.floor(F.col("before") / block_terms).alias("block")), "item"))
    held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    wanted = stored(asked.select("block", F.explode("terms").alias("term")).distinct().join(held, "term"))
    found = None
    for block in sorted(r["block"] for r in asked.select("block").distinct().collect()):
        its = wanted.where(F.col("block") == block).select("term", "df").collect()             # block_terms and those of one item at most
        number = {bytes(r["term"]): i for i, r in enumerate(its)}
        weights = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["df"] + 1))) for r in its], np.int64)
        rows = asked.where(F.col("block") == block).select("item_id", "terms").orderBy("item").collect()
        listed = [(r["item_id"], [number[t] for t in map(bytes, r["terms"]) if t in number]) for r in rows]
        part = index.mapInArrow(_ranked(list(number), weights, listed, total["docs"], total["terms"], k), "item_id long, doc_id long, row long, score long, item long")
        part = part.withColumn("block", F.lit(block))
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS.format('text')} AS terms FROM documents),
sized AS (SELECT row, doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM sized) GROUP BY row, term),
item AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS.format('text')}) AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT item, item_id, unnest(terms) AS term FROM item),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), total),
s AS (SELECT item, item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN sized USING (row), total GROUP BY item, item_id, doc_id, row)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
