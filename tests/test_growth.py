"""What a step must not do for each row, read off its plan, and that its results stay."""
import datetime
import unicodedata

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallybook.functions.scalars import flex_date, has_word
from tallybook.operators import extract_words as V
from tallybook.operators import match as M
from tallybook.operators import ordering
from tallybook.operators.ordering import id_block
from tallybook.plans import fixtures, queries_text
from tallybook.sources.catalog import bank_label, detect_layout, fold, route, shipped_layouts


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_flex_date_needs_no_parser(spark):
    cases = [("29", "02", "2024"), ("29", "FEV", "23"), ("31", "12", ""), ("56", "HIG", None), ("00", "01", "2024"), ("01", "13", "2024"),
             ("07", "set", "0000"), ("07", "set", "0031"), ("07", "set", "9999"), (None, "01", "2024")]
    df = spark.createDataFrame(cases, "d string, m string, y string").select("*", flex_date(F.col("d"), F.col("m"), F.col("y"), F.lit(2020)).alias("date"))
    day = datetime.date
    assert [r.date for r in df.collect()] == [day(2024, 2, 29), None, day(2020, 12, 31), None, None, None, None, day(31, 9, 7), day(9999, 9, 7), None]
    far = spark.range(1).select(flex_date(F.lit("01"), F.lit("02"), F.lit(""), F.lit(20000)).alias("date"))
    assert far.first().date is None
    # a parser throws for each text that is no date, such as the number before a word in "N56 HIGH"
    assert "timestamp" not in plan(df) and "format_string" not in plan(df)


def test_smart_balances_judge_no_amounts(spark, words):
    data = words((40, 100, "SALDO"), (45, 100, "INICIAL"), (50, 100, "10,00"), (55, 100, "D"), (30, 112, "MOV"), (40, 112, "N56"), (50, 112, "HIGH"),
                 (30, 124, "05/03/2024"), (400, 124, "7,00"), (500, 124, "12,50"), (30, 136, "06/03"), (400, 136, "8,00"),
                 (30, 148, "SALDO"), (500, 148, "20,00"), (30, 160, "07/03/24"), (400, 160, "1,00"), (500, 160, "21,00"), (30, 172, "TARIFA"))
    out = V.smart_balances(data, 2020)
    assert [(float(r.bal_start), float(r.bal_end)) for r in out.collect()] == [(-10, 21)]
    # words that sign an amount or leave a line out of a memo are the transactions' business
    assert "TARIFA" not in plan(out) and "BLOQUEADO" not in plan(out)


def test_smart_balances_of_one_line_with_both(spark, words):
    data = words((30, 100, "05/03/2024"), (40, 100, "SALDO"), (400, 100, "7,00"), (500, 100, "12,50"), (510, 100, "D"))
    assert [(float(r.bal_start), float(r.bal_end)) for r in V.smart_balances(data, 2020).collect()] == [(-12.5, 12.5)]


def test_any_sign_rows_of_a_class_far_apart(spark):
    """A class whose rows come from many stretches of ids: some blocks, not one block a row, and one join for place and run."""
    day, step = datetime.date(2024, 1, 1), 150_000
    ledger = [(1, day + datetime.timedelta(i % 4), 500 if i % 3 else -500, i * step) for i in range(40)] + [(None, day, 500, 7), (1, None, 500, 8)]
    bank = [(1, day + datetime.timedelta(i % 5), -500 if i % 4 else 500, i * step + 1) for i in range(36)] + [(None, day, 500, 9), (1, None, 500, 10)]
    schema = "account_id int, date date, cents bigint, row_id bigint"
    out = M.match_any_sign(spark.createDataFrame(bank, schema), spark.createDataFrame(ledger, schema), ["account_id"])
    free, want = sorted(x for x in ledger if x[0] and x[1]), set()
    for b in sorted((x for x in bank if x[0] and x[1]), key=lambda x: x[1:]):
        near = sorted((x for x in free if abs((x[1] - b[1]).days) <= 3), key=lambda x: (x[2] != b[2], x[1], x[3]))
        if near:
            free.remove(near[0])
            want.add((b[3], near[0][3], b[2] != near[0][2]))
    assert {(r.bank_id, r.ledger_id, r.opposite_sign) for r in out.collect()} == want
    blocks = spark.range(0, 60 * step, step).select(id_block("id").alias("b")).distinct().count()
    assert blocks <= 9
    assert plan(out).count("Join Inner") <= 5


def test_sicoob_writes_no_words(spark, words, monkeypatch):
    """What the carry writes and shuffles is one plain row a line."""
    seen = []
    monkeypatch.setattr(ordering, "stored", lambda df: (seen.append(df.dtypes), df)[1])
    data = words((30, 100, "05/03/2024"), (100, 100, "PIX"), (450, 100, "1.234,56D"), (530, 100, "7,00D"), (100, 112, "REF"), (100, 124, "TED"), (450, 124, "-5,00C"),
                 (100, 136, "SALDO"), (110, 136, "DO"), (120, 136, "DIA"), (530, 136, "9,00*"))
    got = sorted((r.line_no, str(r.date), float(r.amount), r.memo, r.balance and float(r.balance)) for r in V.extract_sicoob(data).collect())
    assert got == [(100, "2024-03-05", -1234.56, "PIX REF", -7.0), (124, "2024-03-05", 5.0, "TED", None)]
    assert seen and not [t for t in seen[0] if t[1].startswith("array") or t[0] in ("words", "text")]


def test_has_word_finds_what_contains_finds(spark):
    texts = ["", "x", "saldo.", "mod. 1", "modx1", "S A L D O", "a-b", "péri: [x] ^", "PÁGINA", "página", "]", "\nSAC:"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for words_ in (["SALDO", "MOD.", "S A L D O"], ["-", "]", "^", "PÁGINA"], ["SAC:"], ["A-B", "PIX +"]):
        assert [r.h for r in df.select(has_word("t", words_).alias("h")).collect()] == [any(w in t.upper() for w in words_) for t in texts]


def test_detection_compares_folded_texts(spark):
    """A page is folded once; a comparison by collation walked each text again for each keyword."""
    pages = spark.createDataFrame([("a", 1, "Agencia 1\nLOTE 2"), ("b", 1, "extrato por periodo"), ("c", 1, "x")], "file string, page_no int, text string")
    out = route(detect_layout(pages, shipped_layouts()))
    assert {r.file: r.rule_set for r in out.collect()} == {"a": "bb", "b": "cef", "c": None}
    assert "collat" not in plan(out).lower()


def test_pages_of_tables_in_one_piece_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """Each table is one row group, which one task reads: the work on its texts is not that task's alone."""
    n = 4_000
    customers = pa.table({"c_custkey": range(n), "c_name": ["Customer"] * n, "c_mktsegment": ["BUILDING"] * n})
    pq.write_table(customers, tmp_path / "customer.parquet")
    pq.write_table(pa.table({"doc_id": range(n), "text": [None, "", "Agência 1, lote 2", "x"] * (n // 4)}), tmp_path / "documents.parquet")
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", n // 10)
    pages = queries_text.pages_text(spark, str(tmp_path))
    held = [r["count"] for r in pages.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 2 * n and max(held) < n / 5
    rules = {r.rule_set: r["count"] for r in queries_text.l4(spark, str(tmp_path)).where("file like 'd%'").groupBy("rule_set").count().collect()}
    assert rules == {"bb": n // 4, None: n * 3 // 4}


def test_fold_walks_a_text_once(spark):
    """No regular expression: each decoded the text again, and one of them had it put in upper case twice."""
    texts = ["Lançamentos do PERÍODO", "lanc\u0327amentos peri\u0301odo", "Straße, ﬁm, ſaldo, ı", "\u0345x\u0344", "漢字🙂 A\U0001e000\U000e0100b", "e\u0301\u0302\u20d0", "Ὰ ᾼ Ώ", "plain 1\n", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fold("t").alias("f"))
    want = [t and "".join(x for x in unicodedata.normalize("NFD", t.upper()) if unicodedata.category(x) != "Mn") for t in texts]
    assert [r.f for r in df.orderBy("i").collect()] == want
    assert "rlike" not in plan(df).lower() and "regexp" not in plan(df).lower()


def test_bank_label_of_marked_texts(spark):
    pages = spark.createDataFrame([("a", 1, "AGE\u0302NCIA 1\nlo\u0301te"), ("b", 1, "Extrato por perı\u0301odo"), ("c", 1, "\u0301")], "file string, page_no int, text string")
    out = detect_layout(pages, shipped_layouts()).select("file", bank_label("bank_id").alias("label"))
    assert [r.label[-5:] for r in out.orderBy("file").collect()] == ["(001)", "(104)", "ctado"]


def test_sums_that_grow_with_the_rows_are_not_sent_to_the_driver(spark):
    from tallybook.operators.match import one_to_one_runs, tag_side
    from tallybook.operators.ordering import id_block, ordinal
    side = spark.range(2_000).selectExpr("id AS row_id", "id % 7 AS account_id", "date_add(date '2024-01-01', cast(id % 300 AS int)) AS date", "id % 11 AS cents")
    placed = ordinal(side.withColumn("blk", id_block(bits=4)), ["account_id"], ["date", "blk"], ["row_id"], "pos")
    tagged = tag_side(side, one_to_one_runs(side, side, ["account_id"], tol=None), ["account_id"], "l")
    for df in (placed, tagged):
        assert df.count() == 2_000 and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.account_id, r.pos) for r in placed.collect()) == [(a, i + 1) for a in range(7) for i in range(len(range(a, 2_000, 7)))]


def test_sheets_of_rows_with_one_id(spark):
    from tallybook.operators.report import report_sheets
    rows = [(1, "S-9"), (1, "S-10"), (1, "S-8"), (2, "S-11"), (0, "S-7")]
    view = spark.createDataFrame(rows, "row_id long, group_id string").selectExpr(
        "1L AS account_id", "row_id", "date '2024-01-01' AS date", "5L AS cents", "'x' AS description", "'Banco' AS source", "'Conciliado' AS status", "group_id")
    out = report_sheets(view.repartition(3), ["account_id"]).where("Grupo is not null")
    assert [r.Grupo for r in sorted(out.collect(), key=lambda r: r.ord)] == ["S-7", "S-10", "S-9", "S-8", "S-11"]
