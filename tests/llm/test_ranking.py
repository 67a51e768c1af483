import math
import re
from collections import Counter

import numpy as np
import pytest

from tallybook.llm import ranking as R

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, **settings):
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, row int, terms string").repartition(4)
    items = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")
    return sorted((tuple(r) for r in R.ranked(docs, items, **settings).collect()), key=str)


@pytest.mark.parametrize("shard, block_terms", [(R.SHARD, R.BLOCK_TERMS), (200, 40)])
def test_equals_plain(spark, prose, monkeypatch, shard, block_terms):
    monkeypatch.setattr(R, "SHARD", shard)
    docs = [(i, prose(5 + 37 * i % 200, i, vocabulary=120)) for i in range(300)]
    items = [(i, prose(25, 1000 + i, vocabulary=150)) for i in range(12)] + [(20, docs[7][1]), (21, "absent words only"), (22, None), (23, ""), (20, docs[8][1]), (20, docs[7][1])]
    assert got(spark, docs, items, block_terms=block_terms) == plain(docs, items)


def test_odd_rows(spark, odd):
    items = [(1, "word"), (2, "NAÏVE naïve 漢字!"), (3, "a b w1 w2 w3"), (None, "w5 w6"), (4, "w1-w2_w3.W4"), (5, None)]
    assert got(spark, odd, items) == plain(odd, items)
    same = [(i, "one two three") for i in range(25)] + [(None, "one two three"), (3, "one two three")]
    assert got(spark, same + [(90, "four")], items=[(1, "one two"), (2, "four")]) == plain(same + [(90, "four")], [(1, "one two"), (2, "four")])
    assert got(spark, [], items) == [] == got(spark, odd, [])


def test_reads_no_further_than_it_must():
    rng = np.random.default_rng(1)
    n = 100_000
    term = np.concatenate((np.zeros(n, np.int64), np.ones(n, np.int64)))
    doc = np.concatenate((np.arange(n), np.arange(n)))
    times = np.concatenate((rng.integers(1, 3, n), rng.integers(1, 3, n)))
    times[[5, 6, n + 5, n + 6]] = 100_000
    shard = R.Shard(term, doc, times, np.full(n, 100), np.array([3000, 2000]))
    found, scores, read = shard.best(np.array([0, 1]), 2, 0)
    assert sorted(found) == [5, 6] and read <= 4 * R.STRETCH and len(set(scores)) == 1
