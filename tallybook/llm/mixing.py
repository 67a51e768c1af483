"""Mixing sources to target weights, block by block.

The words of a source, document after document, are one stream that is cut into blocks of equal length. Each output shard draws
from a multinomial how many of its slots every source fills; a last shard settles what the draws missed or exceeded. The slots of a source
are numbered over all shards; number k takes the block that a pseudorandom permutation of the source's blocks has at k, and
after all blocks were taken once, the next permutation begins. Slots and blocks are joined by index.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.llm import bundles as B
from tallybook.llm import texts as X
from tallybook.operators.ordering import exclusive_prefix
from tallybook.session import cut_lineage

BLOCK = 64          # words
SHARD = 4096        # slots
WEIGHTS = (3, 1, 2)
SHARE = 1.5         # of all words
MOST = 2            # times that a word may be taken
BUNDLE_ROWS = 4_096


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words wanted of each source: ``share`` of all words by weight, none above ``most`` times its size, the excess reshared by weight."""
    left, weight = share * sum(sizes), float(sum(weights))
    out = [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i]):
        cap = float(most * sizes[i])
        out[i] = cap if cap * weight <= left * weights[i] else left * weights[i] / weight
        left, weight = left - out[i], weight - weights[i]
    return out


def permuted(at: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of ``at`` in the permutation of 0 to n - 1 that ``key`` names: a Feistel network, walked until the place is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = at.astype(np.uint64), np.arange(len(at))
    key = X.mix(key.astype(np.int64).view(np.uint64))
    while len(todo):
        h, m, v = half[todo], mask[todo], x[todo]
        a, b = v >> h, v & m
        for r in range(4):
            a, b = b, a ^ (X.mix(b + key[todo] + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) & m)
        x[todo] = a << h | b
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def _filled(seed: int):
    """Slots of each run of a source's numbers, some thousand at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, no, blocks, first, end in zip(*(b.column(c).to_pylist() for c in ("shard", "no", "blocks", "first", "end")), strict=True):
                for at in range(first, end, 1 << 16):
                    k = np.arange(at, min(end, at + (1 << 16)))
                    epoch = k // blocks
                    key = X.mix(X.mix(np.full(1, seed, np.uint64) + np.uint64(no)) + epoch.astype(np.uint64))
                    block = permuted(k % blocks, np.full(len(k), blocks), key.view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), shard)), pa.array(np.full(len(k), no)), pa.array(k), pa.array(epoch), pa.array(block)],
                                                     ["shard", "no", "k", "epoch", "block"])
    return run


def _draws(sources: pd.DataFrame, shards: int, total: int, seed: int):
    share = sources["slots"].to_numpy(float) / max(1, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column("id").to_pylist():
                n = np.random.default_rng([seed, shard]).multinomial(min(SHARD, total - shard * SHARD), share)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard)), pa.array(np.arange(len(n))), pa.array(n.astype(np.int64))], ["shard", "no", "n"])
    return run


class Mix:
    """The mix of one documents table; its parts are DataFrames.

    ``docs``: a row for each row given: doc_id, tie (hash of the row), size, source, no (of the source), source_size, target, begin (in the stream).
    ``slots``: shard, no, k, epoch, block. ``pieces``: a row for each document in a slot: shard, no, k, epoch, doc_id, tie, begin, start (word), n_words.
    """

    def __init__(self, rows: DataFrame, weights: Callable[[list], list[float]] | None = None, block: int = BLOCK, seed: int = 1, share: float = SHARE, most: int = MOST):
        spark = rows.sparkSession
        docs = cut_lineage(rows.select("doc_id", "source", X.n_words(F.col("text")).alias("size"), F.xxhash64(*[c for c, t in rows.dtypes if t != "map"]).alias("tie")))
        found = docs.groupBy("source").agg(F.sum("size").alias("size")).collect()         # one row for each source, as its weight is configuration
        found = sorted(found, key=lambda r: (r.source is None, (r.source or "").encode()))
        sizes = [r["size"] for r in found]
        weigh = weights([r.source for r in found]) if weights else [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(found))]
        want = targets(sizes, weigh, share, most)
        blocks = [-(-s // block) for s in sizes]
        slots = [min(most * b, round(t * b / s)) if s else 0 for s, b, t in zip(sizes, blocks, want, strict=True)]
        table = pd.DataFrame({"source": [r.source for r in found], "no": range(len(found)), "source_size": sizes, "target": want, "blocks": blocks, "slots": slots})
        self.sources = spark.createDataFrame([tuple(r) for r in table.astype(object).itertuples(index=False)], "source string, no long, source_size long, target double, blocks long, slots long")
        self.block, self.most = block, most
        self.docs = self._placed(docs)
        self.slots = self._slots(table, sum(slots), seed)
        own = self.docs.where("size > 0").select(
            "no", "doc_id", "tie", "begin", "size", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))).alias("block"))
        start = F.greatest(F.lit(0), F.col("block") * block - F.col("begin"))
        end = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("begin"))
        own = own.select("no", "doc_id", "tie", "begin", "block", start.alias("start"), (end - start).alias("n_words"))
        self.pieces = self.slots.join(own, ["no", "block"])

    def _placed(self, docs: DataFrame) -> DataFrame:
        """Each document's first word in its source's stream: sums inside a bundle of ids, then over bundles."""
        docs = docs.withColumnRenamed("source", "of").join(self.sources.select("source", "no", "source_size", "target"), F.col("of").eqNullSafe(F.col("source"))).drop("of")
        docs, _ = B.with_bundle(docs, "doc_id", F.lit(1), BUNDLE_ROWS)
        before = (Window.unboundedPreceding, -1)
        inside = Window.partitionBy("no", "bundle").orderBy(F.col("doc_id").asc_nulls_last(), "tie").rowsBetween(*before)
        sums = docs.groupBy("no", "bundle").agg(F.sum("size").alias("n")).withColumn("range", F.shiftright("bundle", 12))
        sums = exclusive_prefix(sums, ["no"], ["range", "bundle"], "n", "off").select("no", "bundle", "off")
        return (docs.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["no", "bundle"])
                .withColumn("begin", F.col("off") + F.col("within")).drop("off", "within", "bundle"))

    def _slots(self, table: pd.DataFrame, total: int, seed: int) -> DataFrame:
        spark = self.sources.sparkSession
        shards = -(-total // SHARD)
        drawn = spark.range(0, shards, 1, min(max(1, shards), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(_draws(table, shards, total, seed), "shard long, no long, n long")
        drawn = exclusive_prefix(drawn.withColumn("range", F.shiftright("shard", 12)), ["no"], ["range", "shard"], "n", "first").join(self.sources.select("no", "blocks", "slots"), "no")
        filled = drawn.select("shard", "no", "blocks", "first", F.least(F.col("first") + F.col("n"), "slots").alias("end"))
        sums = drawn.groupBy("no").agg(F.sum("n").alias("n"))
        missed = self.sources.join(sums, "no").where("n < slots").select(F.lit(shards).cast("bigint").alias("shard"), "no", "blocks", F.col("n").alias("first"), F.col("slots").alias("end"))
        # drawn above lies behind an exchange, so no task needs two workers
        return filled.union(missed).where("first < end").mapInArrow(_filled(seed), "shard long, no long, k long, epoch long, block long")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = mix.pieces.groupBy("no", "begin").agg(F.sum("n_words").alias("taken"))
    own = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return mix.docs.join(taken, ["no", "begin"], "left").select("doc_id", "size", "source_size", "target", own.alias("taken"))


def mixed(rows: DataFrame, **settings) -> DataFrame:
    """The documents of the mix: columns of ``rows`` (doc_id, text, source and others), a row for each time a document is taken.

    The first time it is whole wherever all its blocks are taken (its text as it is), later or else it holds the words of the blocks
    taken, joined by one space. Documents without words are never taken. Equal rows are taken like different ones. A null source is a source of its own, a
    null text has no words, rows without doc_id come last in their source. Other columns stay, whatever they are called. A very long text is cut like any other, and must
    fit in a task. Empty in, empty out.
    """
    mix = Mix(rows, **settings)
    taken = mix.pieces.groupBy("doc_id", "tie", "begin", "epoch").agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("took"), F.sum("n_words").alias("n"))
    given = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("given")
    texts = rows.where(X.n_words(F.col("text")) > 0).select(F.col("doc_id").alias("own_id"), F.xxhash64(*[c for c, t in rows.dtypes if t != "map"]).alias("own_tie"), given)
    both = texts.dropDuplicates(["own_id", "own_tie"]).join(taken, F.col("own_tie").eqNullSafe(F.col("tie")) & F.col("own_id").eqNullSafe(F.col("doc_id")))
    both = both.withColumn("words", F.split(X.one_spaced(F.col("given.text")), " "))
    cut = F.array_join(F.flatten(F.transform("took", lambda p: F.slice(F.col("words"), (p["start"] + 1).cast("int"), p["n_words"].cast("int")))), " ")
    text = F.when(F.col("n") == F.size("words"), F.col("given.text")).otherwise(cut)
    return both.select(*[text.alias("text") if c == "text" else F.col(f"given.`{c}`").alias(c) for c in rows.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, as often as it takes them.

    All columns stay. Documents without words, null texts among them, are in no mix. Repeated rows are taken like different ones. Empty in, empty out.
    """
    return mixed(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)
