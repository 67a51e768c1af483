import random

import numpy as np
import pytest

from tallybook.llm import deobfuscate as O
from tallybook.llm import texts as X
from tallybook.llm import toxicity as T

WORDS = "idiot stupid moron you are the worst person and a loser with pathetic ideas good morning little street tell letter".split()


def trained(vocabulary):
    counts = np.zeros((O.N, O.N, O.N))
    rng = random.Random(1)
    x = O.classes("  " + " ".join(rng.choice(vocabulary) for _ in range(4000)) + " ")
    np.add.at(counts, (x[:-2], x[1:-1], x[2:]), 1)

    class Rows:
        @staticmethod
        def toLocalIterator():
            flat = counts.reshape(-1)
            return iter([type("R", (), {"gram": int(i), "n": int(flat[i])}) for i in np.flatnonzero(flat)])
    return O.Restorer(O.language_model(Rows))


@pytest.fixture(scope="module")
def restorer():
    return trained(WORDS)


@pytest.fixture(scope="module")
def wider():
    return trained(WORDS + "ass dumbass trash that incomprehensibilities".split())


@pytest.mark.parametrize("seen, meant", [("1d10t", "idiot"), ("id!ot", "idiot"), ("st00pid", "stopid"), ("$tup1d", "stupid"), ("m0r0n", "moron"), ("l0$er", "loser"), ("stuuuuupid", "stupid"),
                                         ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("m-o-r-o-n", "moron"), ("p@th3tic", "pathetic"), ("iiidiooot", "idiot"), ("s t u p 1 d", "stupid")])
def test_restores(restorer, seen, meant):
    out, n = restorer.restore(f"you are {seen} and good")
    assert n == 1
    if meant != "stopid":
        assert out.split()[2] == meant


@pytest.mark.parametrize("seen, meant", [("idi07", "idiot"), ("idi0+", "idiot"), ("a$$", "ass"), ("dumba$$", "dumbass"), ("tras#", "trash"), ("!diot", "idiot"), ("+rash", "trash"), ("|diot", "idiot"),
                                         ("a s s", "ass"), ("(1d10t", "(idiot"), ("inc0mpr3hen$ib1l1tie$stup1d", "incomprehensibilitiesstupid")])
def test_restores_signs_at_the_ends(wider, seen, meant):
    assert wider.restore(f"you are {seen} and good") == (f"you are {meant} and good", 1)


@pytest.mark.parametrize("seen", ["that***", "that!", "(that", "*that*", "idiot19", "#that", "!!!", "1 2 3"])
def test_signs_that_stand_for_themselves(wider, seen):
    t = f"you are {seen} and good"
    assert wider.restore(t) == (t, 0)


def test_long_runs_stay_whole(wider):
    run = "idiot" * 80 + "stuuupid" + "漢字" * 500
    assert wider.restore(f"so {run} and") == ("so " + run.replace("uuu", "u") + " and", 1)
    assert wider.restore("so " + "a" * 100_000)[1] == 1


def test_plain_text_stays(restorer):
    t = "Good morning, a little letter! Tell 2024 people at 10:30. I am 25% ok (see 3)."
    assert restorer.restore(t) == (t, 0)


def test_every_span_is_suspicious():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab c.1!@é€ 0ü-*") for _ in range(rng.randrange(30))) for _ in range(4000)] + ["", "abc", "ééé", "a€b", "i d i o t"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    odd = O.suspicious(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for t, o in zip(texts, odd):
        assert o or not O.SPAN.search(t), repr(t)


def test_letter_counts_are_whole(docs, odd):
    have = {r.gram: r.n for r in O.letter_counts(docs(odd)).collect()}
    letters = sum(int((O.classes(t or "") > 0).sum()) for _, t in odd)
    assert sum(n for g, n in have.items() if g % O.N) == letters


def table(spark, prose, n=300):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = prose(60, i).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, spark.createDataFrame(labels + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")


def test_score(spark, docs, odd, prose):
    rows, labels = table(spark, prose)
    extra = [(1000 + i, t) for i, (_, t) in enumerate(odd)] + [(None, "an idiot"), (2000, prose(50, 9) + " m0r0n i d i o t scuuuum " + prose(9, 4)), (2001, prose(50, 9) + " " + prose(9, 4))]
    made = T.score(docs(rows + extra), labels)
    assert set(docs(rows).columns) <= set(made.columns)
    have = {r.doc_id: r.toxic_score for r in made.collect()}
    assert made.count() == len(rows + extra) and all(0 <= s <= 1 for s in have.values())
    assert all((have[i] >= T.THRESHOLD) == (i % 4 == 0) for i in range(len(rows)))
    assert have[2000] >= T.THRESHOLD > have[2001]
    assert have[1000] == have[1001] == have[1002]


def test_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.toxic_score < 1e-6 for r in T.score(docs([(1, "x")]), none).collect()] == [True]
    assert T.score(docs([(1, "x")]).limit(0), none).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark, docs, prose):
    rows, labels = table(spark, prose, 120)
    flipped = labels.withColumn("toxic", __import__("pyspark").sql.functions.expr("case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - toxic else toxic end"))
    a = {r.doc_id: r.toxic_score for r in T.score(docs(rows), labels).collect()}
    b = {r.doc_id: r.toxic_score for r in T.score(docs(rows), flipped).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.1")
    rows = T.op6_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    found = sum(r.predicted for r in rows if r.toxic) / max(1, sum(r.toxic for r in rows))
    assert right / len(rows) >= 0.98 and found >= 0.88
