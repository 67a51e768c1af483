"""Substring dedup by fixed-block anchors: passages of many words that an earlier document has too are cut out.

A window is ``length`` consecutive words of one document. Every window holds a whole reference block, as blocks are half as long
and do not overlap. So all blocks are indexed, every rolling window of a block's length probes the index, and only
around hits whole windows are compared; joined hits are the maximal repeats.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallybook.llm import bundles as B
from tallybook.llm import texts as X

ANCHOR_BITS = 32           # of a block's key, beside those that name its bucket; whole windows are compared with 64


class _Words:
    """The words of one bundle of documents."""

    def __init__(self, table: pa.Table):
        self.data, offsets = X.buffer(table, "text")
        self.starts, self.ends, self.before = X.words(self.data, offsets)
        self.ids = X.ids(table, "doc_id")
        sums = X.prefix(self.data.astype(np.uint64) + np.uint64(1))
        self.sums = X.prefix(X.span_hash(sums, self.starts, self.ends))
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(self.before))

    def windows(self, length: int) -> np.ndarray:
        """Where windows of that many words start that lie in one document."""
        at = np.arange(max(0, len(self.starts) - length + 1))
        return at[self.row[at] == self.row[at + length - 1]] if len(at) else at

    def keys(self, at: np.ndarray, length: int) -> np.ndarray:
        return X.span_hash(self.sums, at, at + length)


def _bundle(table: pa.Table) -> int:
    return table.column("bundle")[0].as_py()


def _probe(bits: int, block: int):
    def send(table: pa.Table) -> pa.Table:
        w = _Words(table)
        at = w.windows(block)
        keys = w.keys(at, block) >> np.uint64(64 - bits - ANCHOR_BITS)
        distinct = np.unique(keys)
        index = np.unique(keys[(at - w.before[w.row[at]]) % block == 0])
        return B.requests(_bundle(table), distinct, np.isin(distinct, index, assume_unique=True), bits, bits + ANCHOR_BITS)
    return send


def _near_anchors(w: _Words, hits: np.ndarray, bits: int, block: int, length: int) -> np.ndarray:
    """Starts of the whole windows that hold an anchor: a block that another bundle or another document of this one has too."""
    at = w.windows(block)
    keys = w.keys(at, block) >> np.uint64(64 - bits - ANCHOR_BITS)
    index = np.unique(keys[(at - w.before[w.row[at]]) % block == 0])
    own, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    here = (times > 1) & np.isin(own, index, assume_unique=True)
    anchors = at[B.among(keys, hits) | here[inverse]] if len(at) else at
    whole = w.windows(length)
    if not len(anchors) or not len(whole):
        return whole[:0]
    near = X.covered(len(w.starts), np.maximum(anchors - (length - block), 0), length - block + 1)
    return whole[near[whole]]


def _extend(bits: int, block: int, length: int):
    def send(_key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return B.REQUEST_SCHEMA.empty_table()
        w = _Words(docs)
        at = _near_anchors(w, B.answered(replies, bits, bits + ANCHOR_BITS), bits, block, length)
        keys = np.unique(w.keys(at, length))
        return B.requests(_bundle(docs), keys, np.zeros(len(keys), bool), bits, 64)
    return send


def _cut(bits: int, block: int, length: int, schema: pa.Schema):
    def finish(_key, docs: pa.Table, late: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        w = _Words(docs)
        earlier = B.answered(late, bits, 64)
        gone = np.zeros(len(w.starts), bool)
        whole = w.windows(length)
        if len(whole):
            gone = X.covered(len(w.starts), whole[B.among(w.keys(whole, length), earlier)], length)
            here = _near_anchors(w, earlier[:0], bits, block, length)    # repeats inside the bundle
            own, inverse = np.unique(w.keys(here, length), return_inverse=True)
            least = np.full(len(own), X.NO_ID)
            np.minimum.at(least, inverse, w.ids[w.row[here]])
            gone |= X.covered(len(w.starts), here[least[inverse] < w.ids[w.row[here]]], length)
        return _rows(docs, w, gone, schema)
    return finish


def _rows(docs: pa.Table, w: _Words, gone: np.ndarray, schema: pa.Schema) -> pa.Table:
    text, spans, removed = [], [], []
    raw, offsets = w.data, X.buffer(docs, "text")[1]
    for i in range(docs.num_rows):
        a, b = w.before[i], w.before[i + 1]
        lost = gone[a:b]
        removed.append(int(lost.sum()))
        if not removed[-1]:
            text.append(raw[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
            spans.append([])
            continue
        s, e = X.runs(~lost)
        text.append(b" ".join(raw[w.starts[a + x]:w.ends[a + y - 1]].tobytes() for x, y in zip(s, e, strict=True)).decode("utf-8", "replace"))
        spans.append([{"start": int(x), "n_words": int(y - x)} for x, y in zip(*X.runs(lost), strict=True)])
    made = {"text": text, "n_words": np.diff(w.before), "n_removed": removed, "removed": spans}
    return pa.table([pa.array(made[f.name], f.type) if f.name in made else docs.column(f.name).cast(f.type) for f in schema], schema=schema)


def remove_repeats(docs: DataFrame, length: int = 50, carry: Sequence[str] = (), target: int = 3 << 20) -> DataFrame:
    """Cut each word covered by a window of ``length`` words that also starts in a document with a smaller doc_id.

    Takes ``doc_id`` and ``text``; returns doc_id, text (what is left; its own white space where nothing was cut between two words, one
    space elsewhere), n_words, n_removed (of the input), removed (spans of words), and the columns named in ``carry``.
    Windows are judged on the input. A null text is an empty one and stays empty; rows with one doc_id never remove each
    other's words; a row without doc_id comes after all others; other columns are dropped. Empty in, empty out. One document must fit in a task.
    """
    block = length // 2
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carry)
    slim, n = B.with_weighted_bundle(slim, "doc_id", F.octet_length("text"), target)
    bits = B.bucket_bits(n)
    probes = slim.groupBy("bundle").applyInArrow(_probe(bits, block), B.REQUEST)
    hits = probes.groupBy("bucket").applyInArrow(B.shared_keys, B.REPLY)
    candidates = slim.groupBy("bundle").cogroup(hits.groupBy("bundle")).applyInArrow(_extend(bits, block, length), B.REQUEST)
    late = candidates.groupBy("bucket").applyInArrow(B.earlier_keys, B.REPLY)
    span = T.StructType().add("start", "long").add("n_words", "long")
    out = T.StructType([slim.schema["doc_id"]]).add("text", "string").add("n_words", "long").add("n_removed", "long").add("removed", T.ArrayType(span))
    for name in carry:
        out = out.add(slim.schema[name])
    return slim.groupBy("bundle").cogroup(late.groupBy("bundle")).applyInArrow(_cut(bits, block, length, to_arrow_schema(out)), out)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(X.one_spaced(F.col("text")), 256).alias("kept_sha256"))


#: Every window against every other by content.
OP3_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, r, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM w)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING count(*) > 1),
lost AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (k) WHERE m < doc_id) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(ps, p)), lambda p: ws[p]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (r)"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without their repeated passages; documents of which nothing is left go.

    Returns the columns of documents, others are dropped. A null text becomes an empty one, empty texts stay; rows of one doc_id keep each other's words. Empty in, empty out.
    """
    kept = remove_repeats(docs, carry=["lang", "source"])
    kept = kept.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return kept.select("doc_id", "text", "lang", "source", F.char_length("text").cast("bigint").alias("n_chars"))
