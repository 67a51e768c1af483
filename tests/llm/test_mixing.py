import re
from collections import defaultdict

import numpy as np
import pytest

from tallybook.llm import mixing as M


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def by_rounds(sizes, weights):
    """Targets as told: cap, reshare the excess by weight, until none is above."""
    total = 1.5 * sum(sizes)
    capped = set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(2 * sizes[i] for i in capped)
        t = {i: left * weights[i] / sum(weights[j] for j in rest) for i in rest}
        above = [i for i in rest if t[i] > 2 * sizes[i]]
        if not above:
            return [2.0 * sizes[i] if i in capped else t[i] for i in range(len(sizes))]
        capped |= set(above)


def test_targets():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = [int(x) for x in rng.integers(0, 10 ** rng.integers(1, 6), rng.integers(1, 12))]
        weights = [float(M.WEIGHTS[i % 3]) for i in range(len(sizes))]
        assert M.targets(sizes, weights) == pytest.approx(by_rounds(sizes, weights))
    assert M.targets([], []) == [] and M.targets([0, 0], [3.0, 1.0]) == [0, 0]


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        for key in (1, -5):
            out = M.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(out) == list(range(n))
    assert list(M.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1))) != list(range(1000))


def corpus(prose, odd):
    rows = [(100 + i, prose(20 + i % 90, i)) for i in range(400)]
    return odd + rows + rows[:3]


def test_whole_mix(docs, odd, prose):
    rows = corpus(prose, odd)
    df = docs(rows)
    mix = M.Mix(df)
    taken = mix.pieces.collect()
    source = {r.no: r for r in mix.sources.collect()}
    size = defaultdict(int)
    for i, t in rows:
        size[f"s{(i or 0) % 3}"] += len(words(t))
    assert {r.source: r.source_size for r in source.values()} == dict(size)
    total = defaultdict(int)
    times = defaultdict(int)
    for p in taken:
        total[p.no] += p.n_words
        for w in range(p.begin + p.start, p.begin + p.start + p.n_words):
            times[p.no, w] += 1
    for no, r in source.items():
        assert abs(total[no] - r.target) <= 2 * M.BLOCK
    assert max(times.values()) <= 2
    again = M.Mix(docs(rows, 7))
    key = lambda r: tuple(map(str, r))
    assert sorted(taken, key=key) == sorted(again.pieces.collect(), key=key)


def test_mixed_texts(docs, odd, prose):
    rows = corpus(prose, odd)
    df = docs(rows)
    made = M.mixed(df)
    assert made.columns == df.columns
    have = defaultdict(int)
    for r in made.collect():
        have[r.doc_id] += len(words(r.text))
    want = defaultdict(int)
    for p in M.Mix(df).pieces.collect():
        want[p.doc_id] += p.n_words
    assert have == want


def test_small_and_empty(docs, spark):
    assert M.mixed(docs([(1, "a")]).limit(0)).count() == 0
    assert M.mixed(docs([(1, None), (2, "")])).count() == 0
    one = spark.createDataFrame([(1, "a b c", None)], "doc_id long, text string, source string")
    assert [len(words(r.text)) for r in M.mixed(one).collect()] in ([3, 3], [3])


def test_whole_table(spark, sf):
    rows = {r.doc_id: len(words(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    have = M.op4_mixing(spark, sf).collect()
    assert {r.doc_id: r["size"] for r in have} == rows and len(have) == len(rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in have)
    per = defaultdict(int)
    for r in have:
        per[r.source_size, r.target] += r.taken
    assert all(abs(n - t) <= 2 * M.BLOCK for (_, t), n in per.items())
    assert sum(t for _, t in per) == pytest.approx(1.5 * sum(rows.values()))
