"""Repeats between bundles of documents, without a pair and without a row per window.

Documents are dealt to bundles by ranges of doc_id, so that "in an earlier bundle" implies "in a document with a
smaller doc_id". A bundle sends the sorted, distinct 64-bit keys of its windows, packed as differences, to
the key range (bucket) they belong to. A bucket answers each bundle with the keys that others have too. However often
one window occurs, a bundle names it once, and no task sees more than one bundle or one bucket.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges cut at quantiles of doc_id; beyond that many, each is cut into equal widths of doc_id.
QUANTILES = 4000
REQUEST = "bucket int, bundle long, blob binary, marked binary"
REPLY = "bundle long, bucket int, blob binary"
REPLY_SCHEMA = pa.schema([("bundle", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
REQUEST_SCHEMA = pa.schema([("bucket", pa.int32()), ("bundle", pa.int64()), ("blob", pa.binary()), ("marked", pa.binary())])


def with_bundle(docs: DataFrame, id_col: str, weight: Column, target: int) -> tuple[DataFrame, int]:
    """Adds ``bundle``: growing with the id, with about the same number of rows each, as many as the weights hold ``target``. Rows without an id go to the last one."""
    size = docs.agg(F.sum(weight).alias("n")).first()["n"] or 0
    wanted = max(1, math.ceil(size / target))
    cuts, fine = min(wanted, QUANTILES), math.ceil(wanted / QUANTILES)
    at = F.coalesce(F.col(id_col).cast("double"), F.lit(float(2**63)))
    if cuts > 1:
        shares = [i / cuts for i in range(1, cuts)]
        found = docs.agg(F.percentile_approx(F.col(id_col).cast("bigint"), shares, 10 * cuts).alias("q")).first()["q"]
        found = sorted({float(x) for x in found or []})
    else:
        found = []
    if not found:
        return docs.withColumn("bundle", F.lit(0).cast("bigint")), 1
    edges = [-math.inf, *found, math.inf]
    coarse = Bucketizer(splits=edges, inputCol="__at", outputCol="__range").transform(docs.withColumn("__at", at))
    if fine > 1:
        low, high = F.array(*map(F.lit, [found[0], *found])), F.array(*map(F.lit, [*found, found[-1]]))
        i = F.col("__range").cast("int") + 1
        width = F.greatest(F.element_at(high, i) - F.element_at(low, i), F.lit(1.0))
        part = F.greatest(F.lit(0.0), F.least(F.lit(fine - 1.0), F.floor((F.col("__at") - F.element_at(low, i)) / width * fine)))
    else:
        part = F.lit(0.0)
    return coarse.withColumn("bundle", (F.col("__range") * fine + part).cast("bigint")).drop("__at", "__range"), len(edges) * fine


def with_weighted_bundle(docs: DataFrame, id_col: str, weight: Column, target: int) -> tuple[DataFrame, int]:
    """Adds ``bundle``: growing with the id, with a sum of weights of about ``target`` each, however the weights lie along the ids. Rows without an id are the last one.

    Ranges of equally many rows, eight to a bundle (QUANTILES at most), are weighed and dealt to bundles by the weight before them. A range heavier than a bundle is
    cut into equal widths of the id. One id is never cut.
    """
    id_ = F.col(id_col).cast("double")
    whole = docs.agg(F.sum(weight).alias("n"), F.min(id_).alias("lo"), F.max(id_).alias("hi")).first()
    wanted = math.ceil((whole["n"] or 0) / target)
    if wanted <= 1 or whole["lo"] is None:
        return docs.withColumn("bundle", F.lit(0).cast("bigint")), 1
    ranges = min(8 * wanted, QUANTILES)
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("bigint"), [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first()["q"]
    cuts = sorted({float(x) for x in found})
    ranged = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__at", outputCol="__range").transform(docs.withColumn("__at", F.coalesce(id_, F.lit(math.inf))))
    weighed = {int(r["__range"]): r["n"] for r in ranged.where(F.col(id_col).isNotNull()).groupBy("__range").agg(F.sum(weight).alias("n")).collect()}     # QUANTILES rows at most
    at, held, base, parts = 0, 0, [], []
    for i in range(len(cuts) + 1):
        n = weighed.get(i) or 0
        if held and (n > target or held + n / 2 > target):
            at, held = at + 1, 0
        base.append(at)
        parts.append(max(1, math.ceil(n / target)))
        at, held = (at + parts[-1], 0) if n > target else (at, held + n)
    bundles = at + 2
    i = F.col("__range").cast("int") + 1

    def of_range(values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), i)
    part = F.lit(0.0)
    if max(parts) > 1:
        low, high = of_range([whole["lo"], *cuts]), of_range([*cuts, whole["hi"] + 1])
        part = F.least(of_range([p - 1.0 for p in parts]), F.floor((F.col("__at") - low) / F.greatest(high - low, F.lit(1.0)) * of_range([float(p) for p in parts])))
    bundle = F.when(F.col(id_col).isNull(), bundles - 1).otherwise(of_range(base) + part)
    return ranged.withColumn("bundle", bundle.cast("bigint")).drop("__at", "__range"), bundles


def bucket_bits(bundles: int) -> int:
    """So many buckets that each gets about as many keys as a bundle sends."""
    return max(3, math.ceil(math.log2(max(bundles, 1))))


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences, all lowest bytes first and so on; high bytes that are all zero are left out."""
    if not len(keys):
        return b""
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    planes = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([planes]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpack(blob: bytes | None) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    planes = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=1).reshape(planes, -1)
    wide = np.zeros((body.shape[1], 8), np.uint8)
    wide[:, :planes] = body.T
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64)


def requests(bundle: int, keys: np.ndarray, marked: np.ndarray, bits: int, width: int) -> pa.Table:
    """Rows for the buckets. keys: sorted, distinct, of ``width`` bits; the upper ``bits`` name the bucket. marked: which of them count as index."""
    rest = width - bits
    bucket = (keys >> np.uint64(rest)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))             # buckets without a key are not walked through
    low = keys & np.uint64((1 << rest) - 1)
    rows = [(int(bucket[s]), pack(low[s:e]), pack(low[s:e][marked[s:e]])) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)][:len(starts)], strict=True)]
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([bundle] * len(rows), pa.int64()),
                     pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=REQUEST_SCHEMA)


def gathered(table: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    whose = table.column("bundle").to_pylist()
    sent = [unpack(x) for x in table.column("blob").to_pylist()]
    keys = np.concatenate(sent) if sent else np.zeros(0, np.uint64)
    return whose, sent, keys, np.repeat(np.arange(len(sent)), [len(x) for x in sent])


def replies(table: pa.Table, whose: list[int], answers: list[np.ndarray]) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    rows = [(w, pack(a)) for w, a in zip(whose, answers, strict=True) if len(a)]
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()),
                     pa.array([r[1] for r in rows], pa.binary())], schema=REPLY_SCHEMA)


def shared_keys(table: pa.Table) -> pa.Table:
    """One bucket: to each bundle, its keys that at least two bundles sent and at least one marked."""
    whose, sent, keys, _ = gathered(table)
    found, times = np.unique(keys, return_counts=True)
    marks = [unpack(x) for x in table.column("marked").to_pylist()]
    good = found[(times > 1) & np.isin(found, np.concatenate(marks))] if marks else found[:0]
    return replies(table, whose, [x[np.isin(x, good, assume_unique=True)] for x in sent])


def earlier_keys(table: pa.Table) -> pa.Table:
    """One bucket: to each bundle, its keys that an earlier bundle sent as well."""
    whose, sent, keys, owner = gathered(table)
    order = np.argsort(np.asarray(whose, np.int64), kind="stable")
    rank = np.empty(len(whose), np.int64)
    rank[order] = np.arange(len(whose))
    found, inverse = np.unique(keys, return_inverse=True)
    first = np.full(len(found), len(whose), np.int64)
    np.minimum.at(first, inverse, rank[owner])
    late = first[inverse] < rank[owner]
    ends = np.cumsum([len(x) for x in sent])[:-1] if sent else []
    return replies(table, whose, [x[f] for x, f in zip(sent, np.split(late, ends), strict=True)])


def answered(table: pa.Table, bits: int, width: int) -> np.ndarray:
    """All keys that the buckets sent back to one bundle, sorted."""
    rest = np.uint64(width - bits)
    parts = sorted(zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True), key=lambda x: x[0])
    return np.concatenate([(np.uint64(b) << rest) + unpack(x) for b, x in parts]) if parts else np.zeros(0, np.uint64)


def among(keys: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_set, keys), len(sorted_set) - 1)
    return sorted_set[at] == keys
