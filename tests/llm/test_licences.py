import random
import re

import pytest

from tallybook.llm import licences as L
from tallybook.llm.licence_notices import NO_FAMILY, NOTICES
from tallybook.llm.sparse import calibrated, sigmoid


@pytest.fixture(scope="module")
def classifier():
    rng = random.Random(1)
    syllables = "th on in er an re ti es or st ha at en ea nd to it is ed ou the of and for public work free software version copy".split()
    corpus = [" ".join("".join(rng.choices(syllables, k=rng.randrange(1, 3))) for _ in range(rng.randrange(4, 60))) for _ in range(1500)]
    return L.Classifier(corpus[:1200]), corpus[1200:]


def test_notices_are_found_and_confirmed(classifier):
    model, _ = classifier
    wrong = []
    for family, texts in NOTICES.items():
        for t in texts:
            _, found = model.scan(f"some text before\n{t}\nand behind")
            if [(f, c) for _, f, _, _, c in found] != [(family, True)]:
                wrong.append((family, t[:60], found))
    assert len(wrong) <= 2, wrong


def test_changed_notices(classifier):
    model, _ = classifier
    rng = random.Random(2)
    right = n = 0
    for family, texts in NOTICES.items():
        for t in texts:
            w = t.split()
            if len(w) < 8:
                continue
            w[rng.randrange(len(w))] = "foo"
            n += 1
            right += [f for _, f, *_ in model.scan("# " + " ".join(w))[1]] == [family]
    assert right >= 0.9 * n


def test_no_family(classifier):
    model, unseen = classifier
    assert sum(bool(model.scan(p)[1]) for p in unseen) <= 0.01 * len(unseen)
    assert not any(c for t in NO_FAMILY for *_, c in model.scan(t)[1])
    assert sum(bool(model.scan(t)[1]) for t in NO_FAMILY) <= 1
    assert model.likely([])[1] < L.LIKELY


def test_calibration():
    rng = random.Random(3)
    x = [rng.uniform(-3, 3) for _ in range(4000)]
    y = [int(rng.random() < sigmoid(2 * v - 1)) for v in x]
    a, b = calibrated(x, y)
    assert abs(a - 2) < 0.3 and abs(b + 1) < 0.25


def test_rows(spark, docs, odd):
    rows = odd + [(50, "a\n\nReleased under the MIT License.\n \nb"), (50, "a\n\nReleased under the MIT License.\n \nb"), (51, "\n".join(["Licensed under CC BY-NC 4.0."] * 300))]
    df = docs(rows)
    made = L.scan(df)
    assert made.columns == [*df.columns, "n_paragraphs", "licences"]
    have = made.collect()
    assert len(have) == len(rows)
    mit = [r for r in have if r.doc_id == 50]
    assert all(r.n_paragraphs == 3 and [(x.paragraph, x.family, x.confirmed) for x in r.licences] == [(2, "MIT", True)] for r in mit) and len(mit) == 2
    assert len(next(r for r in have if r.doc_id == 51).licences) == 300
    assert all(r.n_paragraphs == 0 and r.licences == [] for r in have if r.doc_id in (1, 2, 3))
    assert L.scan(df.limit(0)).count() == 0


def test_sampled_paragraphs_are_whole(docs):
    long = "plain words of prose " * 400 + "end"
    assert sorted(L.sampled_paragraphs(docs([(1, f"short\n{long}\n \nThe licence")]))) == sorted([long, "short"])


def test_query_returns_its_finds(spark, docs, tmp_path):
    docs([(1, "a\nb\nReleased under the MIT License."), (2, "none")]).write.parquet(f"{tmp_path}/documents.parquet")
    have = {r.doc_id: r for r in L.op10_licences(spark, str(tmp_path)).collect()}
    assert [(x.paragraph, x.family, x.likeness >= L.ALIKE, x.confirmed) for x in have[1].licences] == [(2, "MIT", True, True)]
    assert have[1].n_confirmed == 1 and have[2].licences == []


def test_whole_table(spark, sf):
    sf = sf.replace("0.001", "0.01")
    known = {"Licensed under the Apache License, Version 2.0.": "Apache", "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
             "Released under the MIT License.": "MIT"}
    have = {r.doc_id: r for r in L.op10_licences(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(have) == len(rows)
    for r in rows:
        want = sorted({f for t, f in known.items() if t in r.text})
        assert have[r.doc_id].families == ",".join(want), r.doc_id
        assert have[r.doc_id].n_paragraphs == len([p for p in r.text.split("\n") if re.search(r"\S", p)])
