import numpy as np
import pytest

from tallybook.llm import embedding_dedup as E


def brute(rows, link=0.93):
    good = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    n = len(rows)
    comp, deg = list(range(n)), [0] * n

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for lab in {rows[k][2] for k in good}:
        for d in {len(rows[k][1]) for k in good}:
            own = [k for k in good if rows[k][2] == lab and len(rows[k][1]) == d]
            if not own:
                continue
            v = np.array([rows[k][1] for k in own], float)
            norm = np.linalg.norm(v, axis=1)
            hit = (v @ v.T) / (norm[:, None] * norm[None]) >= link
            for i, j in zip(*np.nonzero(np.triu(hit, 1))):
                deg[own[i]] += 1
                deg[own[j]] += 1
                comp[find(own[j])] = find(own[i])
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    out = [(r[0], deg[k], least.get(find(k)), r[0] is not None and least.get(find(k)) == r[0]) for k, r in enumerate(rows)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")


def clouds(seed, n, dims=16, noise=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        base = rng.normal(size=dims)
        for _ in range(rng.integers(1, 8)):
            rows.append([float(np.float32(x)) for x in base + noise * rng.normal(size=dims)])
    return rows


def test_against_brute_force(table):
    vs = clouds(1, 150)
    rows = [(i, v, i % 3 if i % 17 else None) for i, v in enumerate(vs)]
    rows += [(1000 + i, rows[5][1], 2) for i in range(4)] + [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [float("inf")] + [1.0] * 15, 1),
                                                             (2005, [None] + [1.0] * 15, 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (None, rows[5][1], 2), (7, rows[7][1], 1), (7, rows[7][1], 1)]
    assert got(E.groups(table(rows), recall=1.0, queries=5000)) == brute(rows)


def test_one_large_cloud_in_parts(table, monkeypatch):
    monkeypatch.setattr(E, "PART", 60)
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in base + 0.12 * rng.normal(size=16)], 1) for i in range(400)]
    assert got(E.groups(table(rows), recall=1.0, queries=5000)) == brute(rows)


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(50, 8))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    index = E.Index(v, 4)
    row, cell = index.visits(u, 0.3)
    _, e1, _, e2 = index.excess(u)
    want = {(r, i * 4 + j) for r in range(50) for i in range(4) for j in range(4) if e2[r, j] <= 0.3 - e1[r, i]}
    assert set(zip(row.tolist(), cell.tolist())) == want


def test_empty_table(table):
    assert E.groups(table([(1, [1.0], 1)]).limit(0)).count() == 0


def test_recall_on_the_table_with_near_copies(spark, sf, table):
    rng = np.random.default_rng(5)
    given = [tuple(r) for r in spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = list(given)
    for k in range(900):
        _, v, label = given[k % 300]
        scale = np.linalg.norm(v) / len(v) ** 0.5
        rows.append((10_000 + k, [float(np.float32(x)) for x in np.array(v) + scale * rng.uniform(0.05, 0.4) * rng.normal(size=len(v))], label))
    have, want = got(E.groups(table(rows))), brute(rows)
    found, there = sum(r[1] for r in have), sum(r[1] for r in want)
    assert there > 1000 and 0.98 * there <= found <= there
    assert all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(have, want))


def test_rare_pairs_beside_a_hot_cluster(table):
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    hot = unit(rng.normal(size=64)) + 0.1 / 8 * rng.normal(size=(1500, 64))
    first = unit(rng.normal(size=(150, 64)))
    vs = np.concatenate((hot, first, first + 0.34 / 8 * rng.normal(size=(150, 64)), rng.normal(size=(1500, 64))))
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(vs)]
    want = brute(rows)
    assert sum(r[1] == 1 for r in want) > 200
    assert got(E.groups(table(rows))) == want


def test_exact_cells_hold_every_link():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.08 * rng.normal(size=x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    index = E.Index(x, 6, exact=True)
    radius = 2 - 2 * 0.93 + 1e-9
    own = dict(enumerate(zip(*[index.excess(y)[i].tolist() for i in (0, 2)])))
    met = set(zip(*[a.tolist() for a in index.visits(x, radius)]))
    linked = np.flatnonzero((x * y).sum(1) >= 0.93)
    assert len(linked) > 100 and all((k, own[k][0] * 6 + own[k][1]) in met for k in linked.tolist())
    assert len(met) < 400 * 36


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(E.op8_embedding_dedup(spark, sf)) == brute(rows)
