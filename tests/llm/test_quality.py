import re
from collections import Counter

import pytest

from tallybook.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(wins)
    again = {i + k for i, w in enumerate(wins) if times[w] > 1 for k in range(5)}
    n = len(words)
    counts = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
    failed = n < 10 or 100 * len(again) > 20 * n
    upper, lower = sum(c.isupper() for c in text), sum(c.islower() for c in text)
    bad = (10 * counts[2] > n or counts[1] < 2 * n or counts[1] > 15 * n or 10 * counts[3] > 3 * len(lines) or upper > lower or 10 * text.count("!") > n
           or 5 * sum(not any(c.isalpha() for c in w) for w in words) > n
           or 10 * sum(x.rstrip(" ").endswith(("...", "…")) for x in lines) > 3 * len(lines) or "lorem ipsum" in text.lower())
    return (*counts, failed, not failed and not bad)


@pytest.fixture
def texts(odd, prose):
    lines = "\n".join(["This line stands here twice over."] * 6 + [f"But line {i} of them stands here only once." for i in range(6)])
    broken = "\n".join(f"Line number {i} of this text has no end..." for i in range(12))
    return odd + [(20, prose(200, 5).upper()), (21, prose(40, 6).replace(" ", "!! ")), (22, prose(40, 7).replace(" ", " | ")), (23, lines), (24, broken), (25, "Lorem ipsum " + prose(60, 8)),
                  (26, " ".join("abcdefghij" * 3 + str(i) for i in range(30))), (27, " ".join(f"{i}{i}{i}" for i in range(50))), (28, prose(90, 9)), (29, prose(6, 1) + " " + prose(300, 10) + " " + prose(6, 1)),
                  (30, "a b c d e " * 3 + prose(40, 11)), (31, "x y z u v w x y z u v w " + prose(200, 12)), (32, "\n".join(["twice"] * 2 + [" twice"]) + prose(30, 13))]


def test_equals_plain(spark, docs, texts):
    got = sorted((tuple(r) for r in Q.judged(docs(texts)).collect()), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in texts), key=str)


def test_filter_keeps_columns_and_rows(spark, docs, texts):
    df = docs(texts).withColumnRenamed("bundle", "words").withColumnRenamed("lang", "rejected_by")
    kept = Q.filtered(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == sorted((i, t) for i, t in texts if i and plain(t)[-1])
    assert sum(r.doc_id is None for r in kept.collect()) == sum(i is None and plain(t)[-1] for i, t in texts)
    assert Q.filtered(df.limit(0)).count() == 0 == Q.judged(docs(texts).limit(0)).count()


def test_order_is_rejection_per_cost_and_never_matters():
    m = Q.Measured({"dear": 1.0, "cheap": 0.1, "free": 0.0}, {frozenset({"dear", "cheap"}): 50, frozenset({"dear"}): 10, frozenset(): 40})
    assert m.order() == ["cheap", "dear", "free"]                # the ten left after "cheap" outweigh a rule that rejects nothing


def test_any_order_gives_the_same(spark, docs, texts):
    names = [r.name for r in Q.RULES]
    verdicts = []
    for order in (names, names[::-1], names[3:] + names[:3]):
        found = Q.cascade(Q._own(docs(texts)), Q.RULES, order, "rejected_by")
        verdicts.append(sorted((str(r.doc_id), r.text, r.ok) for r in found.selectExpr("given.doc_id", "text", "rejected_by is null ok").collect()))
    assert verdicts[0] == verdicts[1] == verdicts[2]


def test_no_python_in_the_plan(spark, docs, texts):
    plan = Q.judged(docs(texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.replace("REPARTITION", "").split("judged")[0].replace("Exchange RoundRobin", "")
