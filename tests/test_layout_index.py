import random

import pytest

from tallybook.sources.catalog import detect_layout, identify

LAYOUTS = [("05", "accents", ["Lançamentos", "AGÊNCIA do período"]), ("01", "two", ["agencia 1", "LOTE"]), ("02", "short", ["a", "xy"]), ("03", "none of it", ["not there", "LOTE"]),
           ("04", "long", ["uma linha muito comprida com muitas palavras e mais"]), ("06", "same words", ["LOTE", "agencia 1"]), ("07", "empty word", ["", "saldo"]), ("08", "lines", ["fim\ninicio"])]
PAGES = ["Agencia 1\nLote 7", "lancamentos da agência\nAGENCIA DO PERÍODO", "xyA", "", None, "  ", "Uma linha MUITO comprida com muitas palavras é mais", "o fim\nInício saldo", "saldo 漢字🙂 lote", "xy"]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(f"f{i}", p, t) for i, t in enumerate(PAGES) for p in (1, 2)], "file string, page_no int, text string").filter("page_no = 1 or text is not null")


def table_of(spark, layouts):
    return spark.createDataFrame([(p, n, "b", k) for p, n, k in layouts], "priority string, name string, bank_id string, keywords array<string>")


@pytest.mark.parametrize("more", [[], [("09", "anything", [])]])
def test_index_equals_expression(spark, pages, more):
    layouts = LAYOUTS + more
    listed = [{"name": n, "bank_id": "b", "keywords": k} for _, n, k in sorted(layouts)]
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(detect_layout(pages, table_of(spark, layouts))) == rows(detect_layout(pages, listed))
    got = rows(identify(pages, table_of(spark, layouts)))
    assert got == sorted({(f"f{i}", n) for i, t in enumerate(PAGES) if t for _, n, ks in layouts if all(k in t for k in ks)}, key=str)


def test_null_keywords_and_empty_tables(spark, pages):
    got = detect_layout(pages, table_of(spark, [("1", "x", ["lote", None]), ("2", "y", None)]))
    assert got.filter("layout is not null").count() == 0 and got.count() == len(PAGES)
    assert detect_layout(pages, table_of(spark, [])).filter("layout is not null").count() == 0
    assert detect_layout(pages.limit(0), table_of(spark, LAYOUTS)).count() == 0


def test_many_layouts_with_common_words(spark, pages):
    many = [(f"{i:06}", f"L{i}", ["lote", f"banco numero {i}"]) for i in range(30_000)] + [("1", "last", ["lote", "agencia 1"])]
    got = {r.file: r.layout for r in detect_layout(pages, table_of(spark, many)).collect()}
    assert got["f0"] == "last" and sum(v is not None for v in got.values()) == 1


def test_only_pieces_that_an_anchor_may_have_leave_a_page(spark):
    from tallybook.sources.catalog import _marked, _marked_pieces
    words = ["abcdefgh", "🙂漢字 sem 1", "xyz", "12345678"]
    anchors = spark.createDataFrame([(w, w) for w in words], "word string, piece string")
    texts = ["".join(chr(97 + (i * i + p) % 23) for i in range(3_000)) for p in range(20)] + ["xyabcdefgh", "z", "🙂漢字 sem 1🙂漢字 sem 1", "abcdefg", "h12345678xyz", "xy"]
    pages = spark.createDataFrame(list(enumerate(texts)), "page long, text string").coalesce(1)
    got = {(r.page, r.piece) for r in pages.mapInArrow(_marked_pieces([3, 8, 9], *_marked(anchors)), "page long, piece string").collect()}
    assert {(p, w) for p, t in enumerate(texts) for w in words if w in t and len(w) in (3, 8, 9)} <= got
    assert all(piece in texts[page] for page, piece in got)
    pieces = {(p, t[i:i + q]) for p, t in enumerate(texts) for q in (3, 8, 9) for i in range(len(t) - q + 1)}
    assert len(got) < len(pieces) / 100


def test_a_large_table_marks_few_pieces_by_chance(spark):
    from tallybook.sources.catalog import _marked, _marked_pieces
    words = [f"{i * 7_654_321 % 10**8:08}" for i in range(20_000)]
    anchors = spark.createDataFrame([(w, w) for w in words], "word string, piece string")
    any_of = random.Random(1)
    texts = ["".join(any_of.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)) for _ in range(4)]
    pages = spark.createDataFrame(list(enumerate(texts)), "page long, text string").coalesce(1)
    # no text has a digit, so what leaves is marked by chance
    assert pages.mapInArrow(_marked_pieces([8], *_marked(anchors)), "page long, piece string").count() < 10


def records_shuffled(df):
    """Rows that all exchanges of the query wrote."""
    def of(node):
        kind, metrics = node.getClass().getSimpleName(), node.metrics()
        own = metrics.apply("shuffleRecordsWritten").value() if metrics.contains("shuffleRecordsWritten") and kind == "ShuffleExchangeExec" else 0
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        return own + sum(map(of, below))
    return of(df._jdf.queryExecution().executedPlan())


def test_rows_of_files_and_names_are_not_shuffled(spark):
    k = 300
    pages = spark.createDataFrame([(f"f{i}", 1, "conta corrente\nbanco das linhas") for i in range(k)], "file string, page_no int, text string")
    layouts = [(f"{i:06}", f"L{i}", ["banco das linhas", "conta"]) for i in range(k)]
    # a name of two kinds, twice in one of them, and none
    layouts += [("a", "L0", ["corrente"]), ("b", "L0", ["corrente"]), ("c", None, ["corrente"]), ("d", None, ["conta"]), ("e", "absent", ["conta", "poupança"])]
    found = identify(pages, table_of(spark, layouts))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(f"f{i}", n) for i in range(k) for n in [*(f"L{j}" for j in range(k)), None]}
    assert records_shuffled(found) < k * k / 5


def test_rows_of_one_file_and_null_files(spark):
    rows = [("f", 1, "conta um"), ("f", 1, "conta dois"), (None, 1, "conta um"), (None, 1, "conta um"), ("g", 1, "nada"), ("g", 2, "conta um")]
    pages = spark.createDataFrame(rows, "file string, page_no int, text string")
    layouts = table_of(spark, [("1", "one", ["conta", "um"]), ("2", "two", ["dois"]), ("3", "both", ["um", "dois"])])
    assert sorted(map(tuple, identify(pages, layouts).collect()), key=str) == sorted([("f", "one"), ("f", "two"), (None, "one")], key=str)
    got = sorted(((r.file, r.layout) for r in detect_layout(pages, layouts).collect()), key=str)
    assert got == sorted([("f", "one"), ("f", "one"), (None, "one"), (None, "one"), ("g", None)], key=str)
