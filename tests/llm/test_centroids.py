import hashlib

import numpy as np
import pytest

from tallybook.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v int"


def plain(rows, k, rounds, dims, scale=C.SCALE):
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=name)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        sums = {j: [v for (_, v), o in zip(kept, own) if o == j] for j in set(own)}
        for j, vs in sums.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    inertia = {}
    for _, j, d in out:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in out), key=str)


def got(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r)[:6] for r in C.clustered(df, **settings).collect()), key=str)


def cloud(n, dims, seed, spread=0.2, groups=6):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dims))
    return [(i, (middles[i % groups] + spread * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("rows, k", [
    (cloud(150, 8, 1), 7),
    (cloud(150, 8, 2, spread=3.0), 12),
    ([(i, [float(i % 5)] * 8) for i in range(60)], 6),                       # on one line: no base of more than two pivots
    ([(i, [1.0] * 8) for i in range(20)], 4),                                # all equal: ties, empty clusters
    ([(i, [1e5 * (i % 3), -7e4, 0.0, 0.0, i / 1000, 0.0, 0.0, 1.0]) for i in range(40)], 5),
])
def test_equals_plain(spark, rows, k):
    assert got(spark, rows, k=k, rounds=3, dims=8) == plain(rows, k, 3, 8)


def test_odd_rows(spark):
    good = cloud(30, 8, 3)
    odd = [(100, None), (101, []), (102, [1.0] * 7), (103, [None] + [1.0] * 7), (104, [float("nan")] + [1.0] * 7), (105, [float("inf")] + [1.0] * 7),
           (None, good[0][1]), (5, good[5][1]), (6, good[9][1]), (106, [0.0] * 8), (107, [-0.001] * 8)]
    assert got(spark, good + odd, k=5, rounds=2, dims=8) == plain(good + odd, 5, 2, 8)
    assert got(spark, [(1, good[0][1]), (2, good[1][1])], k=5, rounds=2, dims=8) == plain([(1, good[0][1]), (2, good[1][1])], 5, 2, 8)
    assert got(spark, [(None, good[0][1]), (2, good[1][1])], k=1, rounds=0, dims=8) == plain([(None, good[0][1]), (2, good[1][1])], 1, 0, 8)
    assert got(spark, [(1, [1e30] * 8)], k=5, rounds=2, dims=8) == [] == got(spark, [], dims=8)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(5)
    v = rng.integers(-256, 256, (2000, 64))
    starts = v[:40]
    simplex = C.Simplex(starts)
    assert len(simplex.pivots) == C.PIVOTS
    low, high = C.bounds(simplex.apexes(v), simplex.apexes(starts))
    true = ((v[:, None] - starts[None]) ** 2).sum(2)
    assert (low <= true).all() and (true <= high).all()
    tight = np.array([x for _, x in cloud(2000, 64, 6, spread=0.05, groups=40)])
    whole = np.floor(256 * tight).astype(np.int64)
    simplex = C.Simplex(whole[:40])
    who, d, compared = C.nearest(whole, simplex.apexes(whole), whole[:40], simplex.apexes(whole[:40]))
    true = ((whole[:, None] - whole[None, :40]) ** 2).sum(2)
    assert (who == true.argmin(1)).all() and (d == true.min(1)).all()
    assert compared.mean() < 5
