import random
import re

import numpy as np
import pytest
import xxhash

from tallybook.llm import graph
from tallybook.llm import simhash as S


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 3)
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def brute(rows):
    fps = [plain(t) for _, t in rows]
    distinct = sorted(set(fps))
    x = np.array(distinct, np.uint64)
    comp = {f: f for f in distinct}

    def find(f):
        while comp[f] != f:
            f = comp[f]
        return f
    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= 4):
            comp[find(distinct[i + 1 + j])] = find(f)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted(((i, f"{f:016x}", least.get(find(f))) for (i, _), f in zip(rows, fps)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", S.as_hex("fp"), "component_id").collect()), key=str)


def test_golay_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 20_000)
    keys, n = S.golay_keys(words)
    assert set(np.unique(n)) <= {1, 6}
    for flips in (1, 2):
        other = words.copy()
        for _ in range(flips):
            other ^= 1 << rng.integers(0, 23, len(words))
        k2, n2 = S.golay_keys(other)
        for a, na, b, nb in zip(keys, n, k2, n2):
            assert set(a[:na]) & set(b[:nb])
            if flips == 1:
                assert a[0] in b[:nb] and b[0] in a[:na]


def test_every_pair_within_four_bits_meets():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    ka, oa = S.keys_of(a)
    kb, ob = S.keys_of(b)
    mine = [set() for _ in a]
    for k, o in zip(ka, oa):
        mine[o].add(k)
    hit = np.zeros(len(a), bool)
    for k, o in zip(kb, ob):
        hit[o] |= k in mine[o]
    assert hit.all()
    assert len(ka) / len(a) < 70


@pytest.mark.parametrize("few", [12, 2])
def test_links_of_dense_neighbourhoods(spark, few, monkeypatch):
    """Thousands of fingerprints round one centre: connected, with far fewer rows than pairs."""
    monkeypatch.setattr(S, "FEW", few)
    rng = random.Random(3)
    centre = rng.getrandbits(63)
    fps = {centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(600)} | {rng.getrandbits(63) for _ in range(500)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    comp = {r.node: r.root for r in graph.components(S.links(df)).collect()}
    near = [f for f in fps if bin(f ^ centre).count("1") <= 2]
    assert {comp[f] for f in near} == {min(near)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(250)]
    edges += [(7, 7), (None, 3), (1, 0)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    have = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert have == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups(docs, odd, prose):
    base = prose(300, 7).split()
    rows = odd + [(100 + i, " ".join(base[:i * 7] + ["CHANGED"] + base[i * 7:])) for i in range(40)] + [(200, " ".join(base).upper())]
    have = got(S.groups(docs(rows)))
    assert have == brute(rows)
    assert S.groups(docs(rows).limit(0)).count() == 0


def test_stage(spark, docs, odd):
    rows = odd + [(50 + i, "the same text again and again") for i in range(5)] + [(50, "the same text again and again")]
    kept = S.stage(spark, docs(rows), "").collect()
    best = {c for _, _, c in brute(rows)} - {None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(best)
    assert sum(r.doc_id is None for r in kept) == 1


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    have = S.op7_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((tuple(r) for r in have), key=str) == brute(rows)
