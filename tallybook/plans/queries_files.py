"""Files and streams: Spark writes them from the given tables into the shared folder, then reads them back."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions import words as W
from tallybook.functions.scalars import fmt_brl, from_cents, to_cents
from tallybook.operators.clean import append_batch
from tallybook.operators.match import match_one_to_one
from tallybook.plans.fixtures import KEYS, date_br, ledger_of, movements, orders_bank, raw_ledger, table, to_lines, with_amount
from tallybook.plans.queries_report import TWO
from tallybook.operators.extract_lines import extract_bb_dot
from tallybook.plans.queries_text import REST_SQL, T, bb_dot_lines, c, cef_lines, rows_out
from tallybook.plans.registry import MOVES, RAWS, SIDES, query
from tallybook.session import scratch_path
from tallybook.sinks import files as K
from tallybook.sinks import ofx_writer as O
from tallybook.sinks.commits import read_batches
from tallybook.sinks.ofx_files import write_ofx
from tallybook.sources import catalog as C
from tallybook.sources import ledger_files as G
from tallybook.sources import ofx_files as X
from tallybook.sources.texts import read_statement_lines, with_source_file
from tallybook.streaming.ingest import read_activity_counts, read_bank, stream_activity, stream_bank


def write_texts(df: DataFrame, path: str) -> str:
    """df(folder, ord, value): one folder of ordered lines per name, split by range, read back as whole files per folder.

    Rows of a folder stay in one file: they are bounded by the fixture (a thousand rows and a preamble).
    """
    (df.repartition("folder").sortWithinPartitions("folder", "ord").select("folder", "value")
     .write.partitionBy("folder").text(path))
    return path


# ---- ledger files --------------------------------------------------------------------------------

def ledger_csv(spark, sf) -> str:
    raw = raw_ledger(spark, sf)
    blank = F.lit("")
    cells = [c("transaction_id"), c("key"), c("date"), c("debit_account"), blank, blank, blank, c("credit_account"), blank, blank, blank, c("amount"),
             blank, blank, blank, F.concat(F.lit("Lançto "), c("description"))] + [blank] * 4
    body = raw.select(F.col("file").alias("folder"), (c("pos") + 10).alias("ord"), F.concat_ws(";", *cells).alias("value"))
    short = raw.filter(c("pos") % 100 == 5).select(F.col("file").alias("folder"), (c("pos") + 10).alias("ord"), F.lit("x;y;z").alias("value"))
    first = raw.groupBy("file").agg(F.min("pos").alias("p"))
    number = F.regexp_replace("file", "led-", "")
    preamble = F.array(blank, F.concat(F.lit("Consulta de lançamentos da empresa "), number, F.lit(" - Filial São João "), number), blank,
                       F.lit(";".join(f"Campo{i}" for i in range(19))), blank)
    head = first.select(F.col("file").alias("folder"), F.posexplode(preamble).alias("i", "value"), "p").select(
        "folder", (c("p") + c("i")).alias("ord"), "value")
    text = body.unionByName(short).unionByName(head)
    return write_texts(text, scratch_path(spark, "ledger"))


@query("s1_ledger_csv", f"{RAWS} SELECT transaction_id, key, date, debit_account, credit_account, amount, 'Lançto ' || description AS description FROM raw")
def s1(spark, sf):
    out = G.read_ledger_csv(spark, ledger_csv(spark, sf))
    # Spark writes UTF-8; the reader decodes one byte per letter as the export does, so the test letters are put back
    text = F.decode(F.encode("description", "ISO-8859-1"), "UTF-8")
    return out.select("transaction_id", "key", "date", "debit_account", "credit_account", "amount", text.alias("description"))


@query("s4_ledger_company", f"{RAWS} SELECT DISTINCT replace(file, 'led-', '') || ' - Filial São João ' || replace(file, 'led-', '') AS company FROM raw")
def s4(spark, sf):
    out = G.ledger_company(spark, ledger_csv(spark, sf))
    return out.select(F.decode(F.encode("company", "ISO-8859-1"), "UTF-8").alias("company"))


@query("s1_plain_ledger_csv", f"{SIDES} SELECT date, cents, description FROM ledger")
def s1b(spark, sf):
    path = scratch_path(spark, "plain")
    with_amount(ledger_of(spark, sf)).select("date", "amount", "description").write.option("header", "true").csv(path)
    structured = G.read_ledger_csv(spark, path)
    out = G.read_plain_ledger_csv(spark, path, "date string, amount string, description string", structured)
    return out.select("date", to_cents("amount").alias("cents"), "description")


def balance_lines(spark, sf) -> DataFrame:
    """Running balances of the file: the balance printed at a row is a number of its own, the entry is its change."""
    bal = F.concat(fmt_brl(F.abs(from_cents("cents"))), F.when(c("neg"), "C").otherwise("D"), F.lit(" "), c("memo"))
    more = F.when(c("row_id") % 4 == 0, T("REF", c("cust").cast("string")))
    return to_lines(movements(spark, sf), [F.when(c("row_id") % 1000 % 7 == 0, date_br()), bal, more], [F.lit("TRANSPORTE 1,00D")], [F.lit("Total 5,00D")])


@query("s5_ledger_balance_lines", f"""{MOVES}, b AS (SELECT *, cents - coalesce(lag(cents) OVER (PARTITION BY file ORDER BY row_id), 0) AS change,
  last_value(CASE WHEN row_id % 1000 % 7 = 0 THEN date END IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d FROM mov)
SELECT file, page_no, d AS date, abs(change) AS cents, change AS signed_cents, memo || CASE WHEN row_id % 4 = 0 THEN ' REF ' || cust ELSE '' END AS description FROM b""")
def s5(spark, sf):
    return G.ledger_from_balance_lines(balance_lines(spark, sf)).select(
        "file", "page_no", "date", to_cents("amount").alias("cents"), to_cents("signed_amount").alias("signed_cents"), "description")


# ---- OFX -----------------------------------------------------------------------------------------

def ofx_source(spark, sf) -> DataFrame:
    return movements(spark, sf).select("file", "row_id", "date", from_cents("cents").alias("amount"), "memo", F.when(c("neg"), "debit").otherwise("xfer").alias("type"),
                                       F.when(c("row_id") % 3 == 0, F.concat(F.lit("F"), c("row_id").cast("string"))).otherwise("").alias("fitid"),
                                       F.when(c("row_id") % 5 == 0, c("cust").cast("string")).otherwise("").alias("doc_id"))


def ofx_path(spark, sf) -> str:
    blocks = O.to_ofx(ofx_source(spark, sf), ["file"], "20250101000000", bank_id="001", acct_id="4913")
    return write_texts(blocks.select(c("file").alias("folder"), "ord", c("text").alias("value")), scratch_path(spark, "ofx"))


MD5 = "md5(strftime(date, '%Y%m%d') || '000000' || regexp_replace(CAST(CAST(cents / 100.0 AS DECIMAL(18,2)) AS VARCHAR), '(\\.\\d)0$', '\\1') || memo)"
IDENT = f"CASE WHEN row_id % 3 = 0 THEN 'F' || row_id ELSE {MD5} END"


@query("s6_read_ofx", f"""{MOVES} SELECT date, cents, memo AS description, {IDENT} AS fitid, CASE WHEN row_id % 5 = 0 THEN CAST(cust AS VARCHAR) END AS doc_id, 'Bank' AS source FROM mov""")
def s6(spark, sf):
    return X.read_ofx(spark, ofx_path(spark, sf)).select("date", to_cents("amount").alias("cents"), "description", "fitid", "doc_id", "source")


@query("s6_ofx_accounts", f"{MOVES} SELECT '' AS bank, '001' AS agency, '4913' AS account, count(DISTINCT file) AS files FROM mov")
def s6b(spark, sf):
    return X.ofx_accounts(spark, ofx_path(spark, sf)).groupBy("bank", "agency", "account").agg(F.count("*").alias("files"))


@query("s7_file_period", f"{MOVES} SELECT min(date) AS start_date, max(date) AS end_date FROM mov GROUP BY file")
def s7(spark, sf):
    return X.file_period(X.read_ofx(spark, ofx_path(spark, sf))).drop("file")


BLOCK = f"""'          <STMTTRN>' || chr(10) || '            <TRNTYPE>' || CASE WHEN neg THEN 'DEBIT' ELSE 'CREDIT' END || '</TRNTYPE>' || chr(10) || '            <DTPOSTED>' ||
  strftime(date, '%Y%m%d') || '000000</DTPOSTED>' || chr(10) || '            <TRNAMT>' || CAST(CAST(cents / 100.0 AS DECIMAL(18,2)) AS VARCHAR) || '</TRNAMT>' || chr(10) || '            <FITID>' ||
  {IDENT} || '</FITID>' || chr(10) || CASE WHEN row_id % 5 = 0 THEN '          <CHECKNUM>' || cust || '</CHECKNUM>' || chr(10) ELSE '' END ||
  '            <MEMO>' || memo || '</MEMO>' || chr(10) || '          </STMTTRN>'"""


# the whole document as it must come out
OFX_HEAD = """OFXHEADER:100
DATA:OFXSGML
VERSION:102
SECURITY:NONE
ENCODING:UTF-8
CHARSET:1252
COMPRESSION:NONE
OLDFILEUID:NONE
NEWFILEUID:NONE
<OFX>
  <SIGNONMSGSRSV1>
    <SONRS>
      <STATUS>
        <CODE>0</CODE>
        <SEVERITY>INFO</SEVERITY>
      </STATUS>
      <DTSERVER>20250101000000</DTSERVER>
      <LANGUAGE>POR</LANGUAGE>
    </SONRS>
  </SIGNONMSGSRSV1>
  <BANKMSGSRSV1>
    <STMTTRNRS>
      <TRNUID>1001</TRNUID>
      <STATUS>
        <CODE>0</CODE>
        <SEVERITY>INFO</SEVERITY>
      </STATUS>
      <STMTRS>
        <CURDEF>BRL</CURDEF>
        <BANKACCTFROM>
          <BANKID>000</BANKID>
          <ACCTID>00000</ACCTID>
          <ACCTTYPE>CHECKING</ACCTTYPE>
        </BANKACCTFROM>
        <BANKTRANLIST>
          <DTSTART>{LO}</DTSTART>
          <DTEND>{HI}</DTEND>"""
OFX_TAIL = """        </BANKTRANLIST>
        <LEDGERBAL>
          <BALAMT>0.00</BALAMT>
          <DTASOF>20250101000000</DTASOF>
        </LEDGERBAL>
      </STMTRS>
    </STMTTRNRS>
  </BANKMSGSRSV1>
</OFX>"""


@query("k3_to_ofx", f"""{MOVES} SELECT file, row_number() OVER (PARTITION BY file ORDER BY row_id) AS ord, {BLOCK} AS text FROM mov
UNION ALL SELECT file, 0, replace(replace('{OFX_HEAD}', '{{LO}}', strftime(min(date), '%Y%m%d000000')), '{{HI}}', strftime(max(date), '%Y%m%d235959')) FROM mov GROUP BY 1
UNION ALL SELECT file, count(*) + 1, '{OFX_TAIL}' FROM mov GROUP BY 1""")
def k3(spark, sf):
    return O.to_ofx(ofx_source(spark, sf), ["file"], "20250101000000")


@query("k3_ofx_files", f"""{MOVES} SELECT file || '.ofx' AS name, date, cents, memo AS description, {IDENT} AS fitid, CASE WHEN row_id % 5 = 0 THEN CAST(cust AS VARCHAR) END AS doc_id,
  row_number() OVER (PARTITION BY file ORDER BY row_id) AS place FROM mov""")
def k3c(spark, sf):
    path = scratch_path(spark, "ofx")
    write_ofx(ofx_source(spark, sf), ["file"], path, "20250101000000")
    back = X.read_ofx(spark, path).withColumn("name", F.element_at(F.split("file", "/"), -1))
    # internal_id grows with the place in the file; a statement has at most a thousand rows
    place = F.row_number().over(Window.partitionBy("name").orderBy("internal_id")).cast("bigint")
    return back.select("name", "date", to_cents("amount").alias("cents"), "description", "fitid", "doc_id", place.alias("place"))


@query("k3_ofx_span", f"{MOVES} SELECT file, strftime(min(date), '%Y%m%d000000') AS dtstart, strftime(max(date), '%Y%m%d235959') AS dtend FROM mov GROUP BY 1")
def k3b(spark, sf):
    head = O.to_ofx(ofx_source(spark, sf), ["file"], "20250101000000").filter("ord = 0")
    return head.select("file", F.regexp_extract("text", "<DTSTART>(.*?)</DTSTART>", 1).alias("dtstart"), F.regexp_extract("text", "<DTEND>(.*?)</DTEND>", 1).alias("dtend"))


@query("k4_ofx_row", f"{MOVES} SELECT row_id, CASE WHEN neg THEN 'DEBIT' ELSE 'CREDIT' END AS trntype, {IDENT} AS ident, CASE WHEN row_id % 5 = 0 THEN CAST(cust AS VARCHAR) END AS checknum FROM mov")
def k4(spark, sf):
    return O.ofx_row(ofx_source(spark, sf)).select("row_id", "trntype", "ident", "checknum")


# ---- pages, layouts, catalogue -------------------------------------------------------------------

@query("s8_statement_lines", """SELECT CAST(doc_id AS VARCHAR) AS file, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS text FROM
  (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""")
def s8(spark, sf):
    path = scratch_path(spark, "pages")
    table(spark, sf, "documents").select(c("doc_id").cast("string").alias("file"), F.lit(1).alias("page_no"), "text").write.parquet(path)
    return read_statement_lines(spark, path).select("file", "line_no", "text")


def layout_path(spark, sf) -> str:
    """One layout file per nation, as a bank of its own."""
    nation = table(spark, sf, "nation")
    doc = F.to_json(F.struct(c("n_name").alias("name"), F.lpad(c("n_nationkey").cast("string"), 3, "0").alias("bank_id"), F.array("n_name", F.lit("Extrato")).alias("keywords"),
                             F.lit(".*").alias("line_pattern"), F.array(F.struct(F.lit("date").alias("name"), c("n_regionkey").alias("match_group"))).alias("columns")))
    path = scratch_path(spark, "layouts")
    nation.select(c("n_nationkey").alias("folder"), doc.alias("value")).repartition("folder").write.partitionBy("folder").text(path)
    return path


def layouts(spark, sf) -> DataFrame:
    raw = layout_path(spark, sf)
    return C.read_layouts(spark, raw, "*.txt")


LAYOUTS = """WITH lay AS (SELECT n_name AS name, lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS bank_id, n_name || ',Extrato' AS keywords, n_regionkey AS first_group, true AS has_balance_cleanup,
  ',' AS amount_decimal_separator, '%d/%m/%Y' AS date_format FROM nation)"""


@query("s9_read_layouts", f"{LAYOUTS} SELECT * FROM lay")
def s9(spark, sf):
    return layouts(spark, sf).select("name", "bank_id", F.array_join("keywords", ",").alias("keywords"), c("columns")[0]["match_group"].alias("first_group"),
                                     "has_balance_cleanup", "amount_decimal_separator", "date_format")


@query("s10_layout_by_name", f"{LAYOUTS}, one AS (SELECT min(n_name) AS pick FROM nation) SELECT name, bank_id, name = pick AS chosen FROM lay, one")
def s10(spark, sf):
    lay = layouts(spark, sf)
    name = table(spark, sf, "nation").agg(F.min("n_name")).first()[0]
    chosen = C.layout_by_name(lay, name).select("name", "bank_id", F.lit(True).alias("chosen"))
    others = C.layout_names(lay).filter(c("name") != name).join(lay, "name").select("name", "bank_id", F.lit(False).alias("chosen"))
    return chosen.unionByName(others)


@query("s11_file_catalog", f"""{MOVES} SELECT DISTINCT false AS selected, 'TXT' AS type, true AS named, '' AS bank, '001' AS agency, '4913' AS account, strftime(min(date) OVER (PARTITION BY file), '%d/%m/%Y') || ' - ' ||
  strftime(max(date) OVER (PARTITION BY file), '%d/%m/%Y') AS period, file FROM mov""")
def s11(spark, sf):
    blocks = O.to_ofx(ofx_source(spark, sf), ["file"], "20250101000000", bank_id="001", acct_id="4913")
    path = scratch_path(spark, "catalog")
    # a folder named like a file: Spark cannot choose file names, so each statement's part file lies below <name>.ofx
    blocks.select(F.concat("file", F.lit(".ofx")).alias("folder"), "ord", c("text").alias("value")).repartition("folder").sortWithinPartitions("folder", "ord").select(
        "folder", "value").write.partitionBy("folder").text(path)
    accounts = X.ofx_accounts(spark, path).join(X.file_period(X.read_ofx(spark, path)), "file")
    return C.file_catalog(spark, path, accounts, r"\.ofx/[^/]*\.txt$").select(
        "selected", "type", c("path").endswith(F.concat(F.lit("/"), c("filename"))).alias("named"), "bank", "agency", "account", "period", F.regexp_extract("path", r"folder=([^/]*)\.ofx", 1).alias("file"))


@query("s12_source_file", f"{MOVES} SELECT file AS folder, count(*) AS n, CAST(1 AS BIGINT) AS files FROM mov GROUP BY 1")
def s12(spark, sf):
    path = scratch_path(spark, "glob")
    movements(spark, sf).select(c("file").alias("folder"), "row_id").repartition("folder").write.partitionBy("folder").parquet(path)
    return with_source_file(spark.read.parquet(path)).groupBy("folder").agg(F.count("*").alias("n"), F.count_distinct("source_file").alias("files"))


def event_log(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(*K.upload_event(F.concat(c("event_id").cast("string"), F.lit(".csv")), c("event_type"), c("user_id").cast("string"), c("ts")))


@query("s13_read_activity", """SELECT CAST(user_id AS VARCHAR) AS "user", 'Upload: ' || event_id || '.csv' AS action, 'upload' AS category, event_type AS kind, CAST(ts AS DATE) AS day FROM events""")
def s13(spark, sf):
    path = scratch_path(spark, "activity")
    K.append_activity(event_log(spark, sf), path)
    return C.read_activity(spark, path).select("user", "action", "category", c("details")["type"].alias("kind"), F.to_date("timestamp").alias("day"))


@query("s14_banks_dim", "SELECT c_custkey, CASE lpad(CAST(c_custkey % 400 AS VARCHAR), 3, '0') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.BANKS.items()) + " END AS bank_name FROM customer")
def s14(spark, sf):
    cust = table(spark, sf, "customer").withColumn("code", F.lpad((c("c_custkey") % 400).cast("string"), 3, "0"))
    return cust.join(F.broadcast(C.banks_dim(spark)), "code", "left").select("c_custkey", "bank_name")


@query("k7_append_activity", """SELECT CAST(ts AS DATE) AS day, count(*) * 2 AS n, count(DISTINCT event_id) AS files FROM events GROUP BY 1""")
def k7(spark, sf):
    path = scratch_path(spark, "activity")
    events = event_log(spark, sf)
    K.append_activity(events, path)
    K.append_activity(events, path)
    return C.read_activity(spark, path).groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("action").alias("files"))


@query("k7_retried_batch", """SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1""")
def k7c(spark, sf):
    """One batch, written twice; the second call finds it there."""
    path = scratch_path(spark, "activity")
    for _ in range(2):
        K.append_activity(event_log(spark, sf), path, "all")
    return C.read_activity(spark, path).groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))


@query("k7_process_event", """SELECT event_id, 'Processamento: ' || event_id || '.csv → ' || event_type AS action, 'process' AS category FROM events""")
def k7b(spark, sf):
    e = table(spark, sf, "events")
    cols = K.process_event(F.concat(c("event_id").cast("string"), F.lit(".csv")), c("event_type"), F.create_map(F.lit("k"), c("props")), c("user_id").cast("string"), c("ts"))
    return e.select("event_id", *cols).select("event_id", "action", "category")


@query("k5_divergence_files", f"{TWO} SELECT row_id, CASE WHEN source = 'Banco' THEN 'not_in_ledger' ELSE 'not_in_bank' END AS report FROM view1 WHERE group_id = '-1'")
def k5(spark, sf):
    path = scratch_path(spark, "divergences")
    led, bank = match_one_to_one(ledger_of(spark, sf), orders_bank(spark, sf), KEYS)
    K.write_divergences(led, bank, path)
    read = lambda name: spark.read.option("header", "true").csv(f"{path}/{name}").select(c("row_id").cast("bigint").alias("row_id"), F.lit(name).alias("report"))
    return read("not_in_ledger").unionByName(read("not_in_bank"))


@query("d3_append_batch", f"{SIDES} SELECT batch, row_id, cents FROM (SELECT 'b1' AS batch, row_id, cents FROM ledger UNION ALL SELECT 'b2', row_id, cents FROM bank)")
def d3(spark, sf):
    path = scratch_path(spark, "batches")
    append_batch(ledger_of(spark, sf).select("row_id", "cents"), path, "b1")
    append_batch(orders_bank(spark, sf).select("row_id", "cents"), path, "b2")
    return read_batches(spark, path).select("batch", "row_id", "cents")


@query("d3_retried_batch", f"{SIDES} SELECT batch, row_id, cents FROM (SELECT 'b1' AS batch, row_id, cents FROM ledger UNION ALL SELECT 'b2', row_id, cents FROM bank)")
def d3b(spark, sf):
    """The first batch comes twice, and an attempt of the second ended before its commit."""
    path = scratch_path(spark, "batches")
    first, second = ledger_of(spark, sf).select("row_id", "cents"), orders_bank(spark, sf).select("row_id", "cents")
    append_batch(first, path, "b1")
    second.write.parquet(f"{path}/data/attempt=a-lost")
    append_batch(first, path, "b1")
    append_batch(second, path, "b2")
    return read_batches(spark, path).select("batch", "row_id", "cents")


# ---- streams -------------------------------------------------------------------------------------

@query("t1_stream_bank", f"{MOVES} SELECT file, page_no, date, cents, memo FROM mov")
def t1(spark, sf):
    source, sink = scratch_path(spark, "lines"), scratch_path(spark, "bank")
    lines = cef_lines(spark, sf)
    lines.write.parquet(source)
    for _ in range(2):
        stream_bank(spark, source, sink, sink + "-state").awaitTermination()
        # the same statements arrive a second time
        lines.write.mode("append").parquet(source)
    return rows_out(read_bank(spark, sink))


@query("t1_stream_bank_pages", f"{MOVES} SELECT file, page_no, date, cents, {REST_SQL} AS memo FROM mov")
def t1b(spark, sf):
    """A rule with page windows; every page arrives in three parts, and the first part once more."""
    source, sink = scratch_path(spark, "lines"), scratch_path(spark, "bank")
    lines = bb_dot_lines(spark, sf)
    part = lambda i: lines.filter(F.col("line_no") % 3 == i)
    for some in (part(2), part(0), part(1), part(2)):
        some.write.mode("append").parquet(source)
        stream_bank(spark, source, sink, sink + "-state", extract_bb_dot).awaitTermination()
    return rows_out(read_bank(spark, sink))


@query("t2_stream_activity", """SELECT CAST(ts AS DATE) AS day, 'upload' AS category, CAST(user_id AS VARCHAR) AS "user", count(*) AS n FROM events GROUP BY 1, 3""")
def t2(spark, sf):
    """The log arrives in three batches that share all days; one is written twice."""
    source, sink = scratch_path(spark, "activity"), scratch_path(spark, "counts")
    log = event_log(spark, sf)
    for i in (2, 0, 1, 0):
        K.append_activity(log.filter(F.pmod(F.xxhash64("action"), F.lit(3)) == i), source, f"part {i}")
        stream_activity(spark, source, sink, sink + "-state").awaitTermination()
    return read_activity_counts(spark, sink)
