"""Against brute force over every window."""
import hashlib
import re

import pytest

from tallybook.llm import bundles as B
from tallybook.llm import substring_dedup as S


def brute(rows, length):
    split = [(float("inf") if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for a in range(len(w) - length + 1):
            k = tuple(w[a:a + length])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), (n, w) in zip(rows, split):
        lost = [False] * len(w)
        for a in range(len(w) - length + 1):
            if first[tuple(w[a:a + length])] < n:
                lost[a:a + length] = [True] * length
        kept = " ".join(x for x, y in zip(w, lost) if not y)
        out.append((i, len(w), sum(lost), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    from pyspark.sql import functions as F

    from tallybook.llm.texts import one_spaced
    rows = df.select("doc_id", "n_words", "n_removed", F.sha2(one_spaced(F.col("text")), 256)).collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.fixture
def shared(prose):
    rows = []
    hot = prose(75, 99)
    for i in range(60):
        body = prose(90 + i, i)
        rows.append((i * 7, body[: 40 * i] + " " + hot + " " + body[40 * i:] if i % 3 == 0 else body))
    rows += [(500 + i, rows[i][1]) for i in range(5)]                                   # copies
    rows += [(600 + i, " ".join(rows[i][1].split()[10:70])) for i in range(10)]         # parts at another offset
    rows += [(700, hot + " " + hot), (701, " ".join(hot.split()[:50])), (702, " ".join(hot.split()[:49]))]
    return rows


@pytest.mark.parametrize("target", [6 << 20, 3000])
def test_brute_force(docs, shared, target):
    assert got(S.remove_repeats(docs(shared), target=target)) == brute(shared, 50)


def test_many_ranges(docs, shared, monkeypatch):
    monkeypatch.setattr(B, "QUANTILES", 3)
    assert got(S.remove_repeats(docs(shared), target=2000)) == brute(shared, 50)


@pytest.mark.parametrize("target", [6 << 20, 50_000])
def test_odd_rows(docs, odd, target):
    assert got(S.remove_repeats(docs(odd), target=target)) == brute(odd, 50)


def test_spans_and_untouched_text(docs, prose):
    a = prose(80, 5)
    odd_space = "x  y\n\tz " + prose(60, 6)
    rows = {r.doc_id: r for r in S.remove_repeats(docs([(1, a), (2, "p q " + a + " r"), (3, odd_space)])).collect()}
    assert [tuple(x) for x in rows[2].removed] == [(2, 80)] and rows[2].text == "p q r"
    assert rows[3].text == odd_space and rows[3].removed == []


def test_empty_table(docs, spark):
    assert S.remove_repeats(docs([(1, "a")]).limit(0)).count() == 0


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    have = S.op3_substring_dedup(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in have), key=str) == brute(rows, 50)
