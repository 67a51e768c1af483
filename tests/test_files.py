"""Files in and out: bytes on disk against expected rows and texts."""
import datetime
import json
from decimal import Decimal as D

import pytest

from tallybook.operators.journal import to_journal_lines
from tallybook.operators.ledger import to_ledger
from tallybook.plans.extract import extract_statements
from tallybook.plans.queries_text import DOT_LAYOUT
from tallybook.session import shared_dir
from tallybook.sinks.files import append_activity, write_ordered_text
from tallybook.sinks.ofx_writer import to_ofx
from tallybook.sources.catalog import file_catalog, layout_list, read_activity, read_layouts, shipped_layouts
from tallybook.sources.ledger_files import ledger_company, read_ledger_csv, read_plain_ledger_csv
from tallybook.sources.ofx_files import ofx_accounts, read_ofx
from tallybook.sources.texts import head_lines, read_records


def fields(*, n="T1", day="05/03/2024", debit="78", credit="1001", amount="10.50", text="Pagto São"):
    row = [""] * 20
    row[0], row[1], row[2], row[3], row[7], row[11], row[15] = n, "k", day, debit, credit, amount, text
    return ";".join(row)


def ledger_file(tmp_path, name, rows, title="Consulta de lançamentos da empresa 12 - Exemplo Ltda"):
    text = "\r\n".join(["", title, "", ";".join(f"c{i}" for i in range(19)), "", *rows, ""])
    (tmp_path / name).write_bytes(text.encode("latin-1"))


def test_ledger_csv(spark, tmp_path):
    ledger_file(tmp_path, "a.csv", [fields(), fields(n="T2", debit="1001", credit="78", amount="3"), "curta;linha", "",
                                    fields(n="T3", day="31/02/2024"), fields(n="T4", amount="abc"), ";".join(["T5", "k", "06/03/2024", "78"] + [""] * 8)])
    ledger_file(tmp_path, "b.csv", [fields(n="U1")], "Sem titulo")
    raw = read_ledger_csv(spark, str(tmp_path))
    a = raw.filter("file like '%a.csv'")
    assert [r.transaction_id for r in a.orderBy("pos").collect()] == ["T1", "T2", "T3", "T4", "T5"]
    assert a.orderBy("pos").first().description == "Pagto São"
    out = {r.transaction_id: r.amount for r in to_ledger(raw, ["file"]).collect()}
    assert out == {"T1": D("10.50"), "T2": D("-3.00"), "T4": D("0.00"), "T5": D("0.00"), "U1": D("-10.50")}  # one row: both codes tie, the smaller one is the bank
    names = {r.file[-5:]: r.company for r in ledger_company(spark, str(tmp_path)).collect()}
    assert names == {"a.csv": "12 - Exemplo Ltda", "b.csv": "Empresa"}


def test_plain_ledger_csv_only_for_files_without_the_export_shape(spark, tmp_path):
    ledger_file(tmp_path, "a.csv", [fields()])
    (tmp_path / "b.csv").write_text("date,amount,description\n2024-03-05,12.5,x\n2024-03-06,oops,y\n")
    path = str(tmp_path)
    got = read_plain_ledger_csv(spark, path, "date string, amount string, description string", read_ledger_csv(spark, path))
    assert sorted((str(r.date), r.amount, r.description) for r in got.collect()) == [("2024-03-05", D("12.50"), "x"), ("2024-03-06", D("0.00"), "y")]


def test_records_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("\n".join(f"line {i}" for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = read_records(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        assert [r.value for r in rows.orderBy("pos").collect()] == [f"line {i}" for i in range(20000)]
        assert [r.value for r in head_lines(rows, 3).orderBy("idx").collect()] == ["line 0", "line 1", "line 2"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


OFX = """OFXHEADER:100
<OFX><SIGNONMSGSRSV1><SONRS><FI><ORG>Banco Exemplo</FI></SONRS></SIGNONMSGSRSV1>
<BANKACCTFROM>
<BANKID>104
<ACCTID>123-4
</BANKACCTFROM>
<BANKTRANLIST>
<STMTTRN>
<TRNTYPE>DEBIT
<DTPOSTED>20240305120000[-3:BRT]
<TRNAMT>-10,50
<MEMO>Saída \x96 água
</STMTTRN>
<STMTTRN><TRNTYPE>CREDIT</TRNTYPE><DTPOSTED>20240306</DTPOSTED><TRNAMT>7.00</TRNAMT><FITID>9</FITID><MEMO>ok</MEMO></STMTTRN>
<STMTTRN><DTPOSTED>hoje</DTPOSTED><TRNAMT>1</TRNAMT></STMTTRN>
</BANKTRANLIST></OFX>"""


def test_ofx_open_and_closed_tags(spark, tmp_path):
    (tmp_path / "x.ofx").write_bytes(OFX.encode("latin-1"))
    (tmp_path / "junk.ofx").write_text("nothing here")
    rows = read_ofx(spark, str(tmp_path)).orderBy("internal_id").collect()
    assert [(str(r.date), r.amount, r.description, r.fitid) for r in rows] == [
        ("2024-03-05", D("-10.50"), "Saída – água", None), ("2024-03-06", D("7.00"), "ok", "9")]
    acct = ofx_accounts(spark, str(tmp_path)).first()
    assert (acct.bank, acct.agency, acct.account) == ("Banco Exemplo", "104", "123-4")


def test_ofx_records_are_decoded_once(spark, tmp_path):
    """Filters on dates and amounts do not decode a record again; letters of code page 1252 come out, undefined bytes are dropped."""
    (tmp_path / "x.ofx").write_bytes(b"<STMTTRN><DTPOSTED>20240305<TRNAMT>1<MEMO>a \x96 \x80\x81 \xe7</STMTTRN>")
    rows = read_ofx(spark, str(tmp_path))
    assert [r.description for r in rows.collect()] == ["a \u2013 \u20ac \u00e7"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and plan.count("substring_index(") == 1


def test_ofx_document(spark):
    txn = spark.createDataFrame([(1, 1, datetime.date(2024, 3, 5), D("-10.50"), "Luz", "xyz", "", "77"), (1, 2, datetime.date(2024, 3, 9), D("3.00"), "Dep", "dep", "F1", None)],
                                "account_id long, row_id long, date date, amount decimal(18,2), memo string, type string, fitid string, doc_id string")
    text = "\n".join(r.text for r in to_ofx(txn, ["account_id"], "20250101000000").orderBy("ord").collect())
    assert text.startswith("OFXHEADER:100\nDATA:OFXSGML\n") and text.endswith("</BANKMSGSRSV1>\n</OFX>")
    assert "<DTSTART>20240305000000</DTSTART>\n          <DTEND>20240309235959</DTEND>" in text
    # md5 of 20240305000000-10.5Luz
    import hashlib
    assert f"<FITID>{hashlib.md5(b'20240305000000-10.5Luz').hexdigest()}</FITID>\n          <CHECKNUM>77</CHECKNUM>\n            <MEMO>Luz</MEMO>" in text
    assert "<TRNTYPE>DEBIT</TRNTYPE>" in text and "<TRNTYPE>DEP</TRNTYPE>" in text and "<FITID>F1</FITID>\n            <MEMO>Dep</MEMO>" in text


def test_journal_lines(spark, tmp_path):
    entries = spark.createDataFrame([("b2", 1, "2024-03-09", D("5.00"), "B", "78", None, "6670", "", "001"), ("b1", 1, "2024-03-05", D("-1.50"), "A", "78", "9", "6670", None, "D1")],
                                    "id string, account_id long, date string, amount decimal(18,2), description string, conta_debito string, participante_debito string, "
                                    "conta_credito string, participante_credito string, documento string")
    lines = to_journal_lines(entries, ["account_id"])
    want = ["1,05/03/2024,78,9,6670,,-1.50,,A,DCTO,,D1", "2,09/03/2024,78,,6670,,5.00,,B,DCTO,,001"]
    assert [r.line for r in lines.orderBy("n").collect()] == want
    write_ordered_text(lines, ["account_id"], str(tmp_path / "out"), order="n", text="line")
    parts = sorted((tmp_path / "out" / "account_id=1").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == want


def test_activity_both_generations(spark, tmp_path):
    (tmp_path / "old.jsonl").write_text(json.dumps({"timestamp": "2025-12-10T14:48:18.395984", "username": "u1", "action": "Login", "category": "auth", "details": {}}) + "\n")
    (tmp_path / "new.jsonl").write_text(json.dumps({"timestamp": "2025-12-22T09:38:42", "user": "u2", "action": "Upload: a", "category": "upload", "details": {"filename": "a", "type": "ledger"}}) + "\n")
    rows = {r.user: r.details for r in read_activity(spark, str(tmp_path)).collect()}
    assert rows == {"u1": {}, "u2": {"filename": "a", "type": "ledger"}}
    log = str(tmp_path / "log")
    append_activity(read_activity(spark, str(tmp_path)), log, "both")
    assert sorted(p.name for p in (tmp_path / "log" / "data").glob("*/day=*")) == ["day=2025-12-10", "day=2025-12-22"]
    assert {r.user: r.details for r in read_activity(spark, log).collect()} == rows


def test_layout_files_in_name_order(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"name": "B", "bank_id": "1", "keywords": ["x"], "line_pattern": ".*", "columns": [{"name": "date", "match_group": 1}]}, indent=2))
    (tmp_path / "a.json").write_text(json.dumps({"name": "A", "bank_id": "2", "keywords": ["x"], "line_pattern": ".*", "columns": [], "date_format": "%d.%m.%Y"}))
    got = layout_list(read_layouts(spark, str(tmp_path)))
    assert [(x["name"], x["date_format"], x["has_balance_cleanup"]) for x in got] == [("A", "%d.%m.%Y", True), ("B", "%d/%m/%Y", True)]


def test_catalog(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.OFX", "sub/b.pdf", "c.txt"):
        (tmp_path / name).write_text("x")
    got = {r.filename: (r.type, r.period) for r in file_catalog(spark, str(tmp_path)).collect()}
    assert got == {"a.OFX": ("OFX", ""), "b.pdf": ("PDF", "")}


@pytest.mark.parametrize("closing,method,amounts", [("900,00", "Text (Auto-Corrected)", [-100]), ("1.100,00", "Text", [100]), ("5,00", "Text", [100])])
def test_statement_with_repair(spark, lines, closing, method, amounts):
    layout = {**DOT_LAYOUT, "name": "Own", "keywords": ["propria"], "priority": "99"}
    pages = spark.createDataFrame([("f", 1, f"Conta própria\nSaldo Anterior 1.000,00\n15.01.2024 TED 100,00 C\nSaldo Atual {closing}")], "file string, page_no int, text string")
    words = spark.createDataFrame([], "file string, page_no int, x0 double, top double, text string")
    done = extract_statements(pages, words, [*shipped_layouts(), layout], 2024, repair=True)
    assert [int(r.amount) for r in done.txn.collect()] == amounts
    assert done.status.first().method == method


def test_stone_statement_is_turned_round(spark):
    text = "Stone\nDATA TIPO LANÇAMENTO\n10/05/2025 Entrada Recebível 10,00 110,00\nPix\n09/05/2025 Débito Tarifa 1,00 100,00\n08/05/2025 Saída Pagto 5,00 101,00"
    # the layout's code has no rule set; its name has
    pages = spark.createDataFrame([("f", 1, text)], "file string, page_no int, text string")
    words = spark.createDataFrame([], "file string, page_no int, x0 double, top double, text string")
    done = extract_statements(pages, words, shipped_layouts(), 2025)
    rows = done.txn.orderBy("internal_id").collect()
    assert [(r.amount, r.memo) for r in rows] == [(D("-5.00"), "Pagto"), (D("10.00"), "Recebível Pix")]
    bal = done.balances.first()
    assert (bal.bal_start, bal.bal_end) == (D("106.00"), D("110.00"))


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_extraction_reads_its_pages_once(spark):
    from pyspark.sql import functions as F
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text
    rows = [(f"f{i}", p, f"EXTRATO POR PERIODO\n01/02/2025 000123 PIX {p}0,00 C 20,00 C") for i in range(5) for p in (1, 2)]
    pages = spark.createDataFrame(rows, "file string, page_no int, text string").withColumn("text", seen.asNondeterministic()("text"))
    words = spark.createDataFrame([], "file string, page_no int, x0 double, top double, text string")
    done = extract_statements(pages, words, shipped_layouts(), 2025)
    assert done.txn.count() == 10 and [r.tx_count for r in done.status.collect()] == [2] * 5
    assert read.value == len(rows)
