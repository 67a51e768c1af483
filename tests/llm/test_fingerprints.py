import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallybook.llm import fingerprints as P


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(rows):
    """(doc_id, text, edited, next text) by the plain definition."""
    best = {}
    for i, t in rows:
        if i is not None:
            best[i] = max(best.get(i, ""), t or "")
    ring = sorted(best, reverse=True)
    after = {i: ring[(k + 1) % len(ring)] for k, i in enumerate(ring)}
    out = []
    for i, t in rows:
        t = t or ""
        nxt = best[after[i]] if i is not None else ""
        half = len(t) // 2
        out.append((i, t, t[:len(t) - half] + nxt[:half], nxt))
    return out


@pytest.fixture
def run(spark, tmp_path):
    def go(df):
        path = str(tmp_path / f"d{random.random()}")
        df.write.parquet(f"{path}/documents.parquet")
        return P.op1_fingerprints(spark, path)
    return go


def test_edited_texts_and_sketches(docs, odd, prose, run):
    rows = odd + [(100 + 3 * i, prose(5 + i, i)) for i in range(150)] + [(900, "same text here"), (901, "same text here")]
    have = run(docs(rows)).collect()
    want = sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in edited(rows)), key=str)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in have), key=str) == want
    assert len({r.fingerprint for r in have if r.doc_id in (900, 901)}) == 1
    by = {r.doc_id: r for r in have}
    assert by[901].near_next == 1.0
    for i, t, e, n in edited(rows):
        r = by[i]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        a, b = shingles(t), shingles(n)
        if not a & b and (a or b):
            assert r.near_next == 0
        if len(a | shingles(e)) <= 16:
            assert r.near_edited == (len(a & shingles(e)) / len(a | shingles(e)) if a | shingles(e) else 1.0)


def test_sketch_is_threshold_scaled_and_merges(spark, prose):
    rows = [(i, prose(n, 1)) for i, n in enumerate((3000, 40, 700))]
    df = P.with_sketch(spark.createDataFrame(rows, "doc_id long, text string"), "text", "s")
    for r in df.collect():
        assert r.s == sorted(set(r.s)) and len(r.s) >= 16
        assert abs(sum(h < P.threshold() for h in r.s) - len(shingles(r.text)) / 8) < 4 * (len(shingles(r.text)) / 8) ** 0.5 + 1
    a, b = prose(900, 2), prose(900, 3)
    both = spark.createDataFrame([(a, b, f"{a} {b}")], "a string, b string, c string")
    for c in "abc":
        both = P.with_sketch(both, c, f"s{c}")
    r = both.select(P.merged("sa", "sb").alias("m"), "sc", "sa", "sb").first()
    assert set(r.m) <= set(r.sc) and len(set(r.sc) - set(r.m)) <= 4 and set(r.m) == set(r.sa) | set(r.sb)


def test_estimates(spark, prose):
    rows = []
    for k in range(20):
        long, part = prose(6000, k), prose(6000, k).split()[100:900]
        rows.append((long, " ".join(part)))
    df = spark.createDataFrame(rows, "a string, b string")
    df = P.compared(P.with_sketch(P.with_sketch(df, "a", "sa"), "b", "sb"), "sa", "sb", "near", "held")
    got = df.agg(F.avg("near").alias("n"), F.min("held").alias("h")).first()
    assert got.h == 1.0 and abs(got.n - 796 / 5996) < 0.02


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_ring(spark, rows):
    ids = sorted([*random.Random(1).sample(range(-500, 500), 38), -(1 << 63), (1 << 63) - 1])
    have = {r.doc_id: (r.before, r.after) for r in P.neighbours(spark.createDataFrame([(i,) for i in ids], "doc_id long"), rows).collect()}
    assert have == {x: (ids[(k + 1) % 40], ids[k - 1]) for k, x in enumerate(ids)}


def test_empty_table(docs, run):
    assert run(docs([(1, "a")]).limit(0)).count() == 0


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    have = P.op1_fingerprints(spark, sf)
    assert not re.search("Python|Pandas|Arrow", have._jdf.queryExecution().executedPlan().toString())
    got = {r.doc_id: r for r in have.collect()}
    error = []
    for i, t, e, n in edited(rows):
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b = shingles(t), shingles(e)
        error.append(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(sum(error) / len(error)) < 0.02 and sum(map(abs, error)) / len(error) < 0.08
