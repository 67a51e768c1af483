import time

import numpy as np
from pyspark.sql import functions as F

from tallybook.llm import bundles as B


def dealt(df, target):
    made, n = B.with_weighted_bundle(df, "doc_id", F.col("w"), target)
    rows = made.select("doc_id", "w", "bundle").collect()
    assert all(0 <= r.bundle < n for r in rows)
    known = sorted((r.doc_id, r.bundle) for r in rows if r.doc_id is not None)
    assert [b for _, b in known] == sorted(b for _, b in known)
    by_id = {}
    for i, b in known:
        assert by_id.setdefault(i, b) == b
    sums = {}
    for r in rows:
        sums[r.bundle] = sums.get(r.bundle, 0) + r.w
    return sums, n, {r.bundle for r in rows if r.doc_id is None}


def test_long_documents_that_stand_together(spark):
    """Wherever the long texts lie, no bundle holds more than twice its weight."""
    for at in (0, 7_000, 19_600):
        docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when((F.col("id") >= at) & (F.col("id") < at + 400), 200_000).otherwise(500).alias("w"))
        sums, n, _ = dealt(docs, 3 << 20)
        total = 400 * 200_000 + 19_600 * 500
        assert max(sums.values()) <= 2 * (3 << 20) and len(sums) >= total / (3 << 20) / 1.5 and n <= 2 * total / (3 << 20) + 2


def test_null_repeated_and_few_ids(spark):
    rows = [(None, 900)] * 40 + [(5, 700)] * 50 + [(-(10**12), 10), (10**12, 10)] + [(i, 100) for i in range(100, 400)]
    sums, n, null = dealt(spark.createDataFrame(rows, "doc_id long, w long").repartition(5), 4_000)
    assert null == {n - 1} and sums[n - 1] == 36_000
    assert max(v for b, v in sums.items() if b != n - 1) <= 35_000 + 2 * 4_000        # the repeated id is never cut
    for few in ([], rows[:3], rows[:40], [(7, 5_000)] * 3):
        sums, n, _ = dealt(spark.createDataFrame(few, "doc_id long, w long"), 4_000)
        assert sum(sums.values()) == sum(w for _, w in few)


def test_requests(spark):
    """Each key comes back from its bucket, and the time does not grow with the number of buckets."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2))
    marked = rng.random(len(keys)) < .3
    for bits in (3, 10, 24):
        begin = time.perf_counter()
        table = B.requests(4, keys, marked, bits, 64)
        assert time.perf_counter() - begin < 5           # 2^24 buckets, of which 20,000 have a key
        rest = np.uint64(64 - bits)
        buckets = table.column("bucket").to_pylist()
        assert buckets == sorted(set(buckets)) and set(table.column("bundle").to_pylist()) == {4}
        for name, want in (("blob", keys), ("marked", keys[marked])):
            have = [(np.uint64(b) << rest) + B.unpack(x) for b, x in zip(buckets, table.column(name).to_pylist(), strict=True)]
            assert np.array_equal(np.concatenate(have), want)
    assert B.requests(4, keys[:0], marked[:0], 10, 64).num_rows == 0
