"""Row cleaning, scalars, ledger rules, balances, deduplication and journal entries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions import scalars as S
from tallybook.operators import balance as B
from tallybook.operators import clean as P
from tallybook.operators import journal as J
from tallybook.operators import ledger as L
from tallybook.operators import ordering as O
from tallybook.operators.extract_lines import extract_cef, extract_simple
from tallybook.plans.fixtures import date_br, ledger_of, movements, orders_bank, raw_ledger, table, to_lines, with_amount
from tallybook.plans.queries_text import BR_ABS, T, balance_cents, c, cef_lines
from tallybook.plans.registry import BANK, LEDGER, MOVES, RAWS, SIDES, query
from tallybook.sources.catalog import activity_stats, banks_dim

MONEY = "decimal(18,2)"


# ---- scalars -------------------------------------------------------------------------------------

@query("f1_br_amount_abs", f"{MOVES} SELECT row_id, abs(cents) AS a, abs(cents) AS b, CAST(0 AS BIGINT) AS z FROM mov")
def f1(spark, sf):
    mov = movements(spark, sf)
    signed_txt = F.concat(F.when(c("neg"), "-").otherwise(""), c("mag_txt"))
    return mov.select("row_id", S.to_cents(S.br_amount_abs("mag_txt")).alias("a"), S.to_cents(S.br_amount_abs(signed_txt)).alias("b"),
                      S.to_cents(S.br_amount_abs("memo")).alias("z"))


@query("f2_br_amount_signed", f"{MOVES} SELECT row_id, cents FROM mov")
def f2(spark, sf):
    txt = F.concat(F.when(c("neg"), "-").otherwise(""), c("mag_txt"))
    return movements(spark, sf).select("row_id", S.to_cents(S.br_amount_signed(txt)).alias("cents"))


@query("f3_br_amount_suffix", f"{MOVES} SELECT row_id, cents AS marked, abs(cents) AS dashed FROM mov")
def f3(spark, sf):
    dashed = F.concat(F.when(c("neg"), "-").otherwise(""), c("mag_txt"), F.lit("*"))
    return movements(spark, sf).select("row_id", S.to_cents(S.br_amount_suffix(F.concat("mag_txt", "dc"))).alias("marked"),
                                       S.to_cents(S.br_amount_suffix(dashed)).alias("dashed"))


@query("f4_amount_with_seps", f"{MOVES} SELECT row_id, abs(cents) AS br, abs(cents) AS us FROM mov")
def f4(spark, sf):
    us = F.format_number(F.abs(S.from_cents("cents")), 2)
    return movements(spark, sf).select("row_id", S.to_cents(S.amount_with_seps("mag_txt", ".", ",")).alias("br"),
                                       S.to_cents(S.amount_with_seps(us, ",", ".")).alias("us"))


@query("f5_layout_date", f"{MOVES} SELECT row_id, date AS a, date AS b, CAST(NULL AS DATE) AS bad FROM mov")
def f5(spark, sf):
    return movements(spark, sf).select("row_id", S.to_layout_date(date_br(), "%d/%m/%Y").alias("a"), S.to_layout_date(date_br("dd.MM.yy"), "%d.%m.%y").alias("b0"),
                                       S.to_layout_date(F.concat(F.lit("32/"), date_br("MM/yyyy")), "%d/%m/%Y").alias("bad")).select(
        "row_id", "a", F.when(F.year("b0") > F.year("a"), F.add_months("b0", -1200)).otherwise(F.col("b0")).alias("b"), "bad")


@query("f6_flex_date", f"""{MOVES} SELECT row_id, TRY_CAST('2024' || strftime(date, '-%m-%d') AS DATE) AS no_year,
  TRY_CAST('20' || strftime(date, '%y-%m-%d') AS DATE) AS short_year, date AS named FROM mov""")
def f6(spark, sf):
    day, year = F.date_format("date", "dd"), F.lit(2024)
    name = F.element_at(F.array(*[F.lit(m.lower()) for m in S.W.MONTHS]), F.month("date"))
    return movements(spark, sf).select("row_id", S.flex_date(day, F.date_format("date", "MM"), F.lit(""), year).alias("no_year"),
                                       S.flex_date(day, F.date_format("date", "MM"), F.date_format("date", "yy"), year).alias("short_year"),
                                       S.flex_date(day, name, F.date_format("date", "yyyy"), year).alias("named"))


@query("f7_sign_by_keywords", """SELECT doc_id, CASE WHEN regexp_matches(u, 'DEBITO|PAGTO|ENVIADO|SAQU|TARIFA|PIX -|PGTO|RESGATE') THEN -n_chars
  WHEN regexp_matches(u, 'CREDITO|RECEBIDO|ESTORN|DEPOSITO|PIX \\+|APLICA') THEN n_chars ELSE n_chars END AS signed FROM (SELECT *, upper(replace(text, 'ß', 'ss')) AS u FROM documents)""")
def f7(spark, sf):
    out = S.sign_by_keywords(c("n_chars").cast(MONEY), c("text"), S.W.DEBIT_WORDS, S.W.CREDIT_WORDS)
    return table(spark, sf, "documents").select("doc_id", out.cast("bigint").alias("signed"))


@query("f8_contains_ci_ai", """SELECT doc_id, contains(strip_accents(lower(text)), 'nacao') OR contains(strip_accents(lower(text)), 'informacion') AS hit FROM documents""")
def f8(spark, sf):
    hit = S.contains_ci_ai("text", F.lit("Nação")) | S.contains_ci_ai("text", F.lit("INFORMACIÓN"))
    return table(spark, sf, "documents").select("doc_id", hit.alias("hit"))


@query("f9_clean_desc", f"{MOVES} SELECT row_id, memo AS cleaned FROM mov")
def f9(spark, sf):
    noisy = F.concat(F.lit("  "), F.lower(F.replace("memo", F.lit(" "), F.lit(" \t  "))), F.lit(" "))
    return movements(spark, sf).select("row_id", S.clean_desc(noisy).alias("cleaned"))


@query("f10_fmt_brl", f"{MOVES} SELECT row_id, CASE WHEN neg THEN '-' ELSE '' END || {BR_ABS} AS shown FROM mov")
def f10(spark, sf):
    return movements(spark, sf).select("row_id", S.fmt_brl(S.from_cents("cents")).alias("shown"))


@query("f11_date_br", f"{MOVES} SELECT row_id, strftime(date, '%d/%m/%Y') AS a, strftime(date, '%d/%m/%Y') AS b, memo AS kept FROM mov")
def f11(spark, sf):
    return movements(spark, sf).select("row_id", S.fmt_date_br("date").alias("a"), S.iso_text_to_br(F.date_format("date", "yyyy-MM-dd")).alias("b"),
                                       S.iso_text_to_br("memo").alias("kept"))


@query("f12_ellipsis", "SELECT doc_id, CASE WHEN length(text) > 55 THEN left(text, 55) || '...' ELSE text END AS short, left(text, 60) AS cut FROM documents")
def f12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.ellipsis("text").alias("short"), F.left("text", F.lit(60)).alias("cut"))


@query("f13_surrogate_id", f"""{MOVES} SELECT row_id, md5(strftime(date, '%Y%m%d') || '000000' || regexp_replace(CAST(CAST(cents / 100.0 AS DECIMAL(18,2)) AS VARCHAR), '(\\.\\d)0$', '\\1') || memo) AS id FROM mov""")
def f13(spark, sf):
    return movements(spark, sf).select("row_id", S.surrogate_id(c("date"), S.from_cents("cents"), c("memo")).alias("id"))


@query("f14_detail", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def f14(spark, sf):
    return table(spark, sf, "events").select("event_id", S.detail("props", "k").alias("k"))


# ---- rows ----------------------------------------------------------------------------------------

@query("p1_recon_rows", f"{MOVES} SELECT file, date, cents, memo AS description, 'Bank' AS source FROM mov")
def p1(spark, sf):
    return P.to_recon_rows(extract_cef(cef_lines(spark, sf))).select("file", "date", S.to_cents("amount").alias("cents"), "description", "source")


@query("p2_ensure_columns", f"{SIDES} SELECT row_id, date, cents, description, CAST(NULL AS VARCHAR) AS source FROM ledger")
def p2(spark, sf):
    out = P.ensure_columns(ledger_of(spark, sf), {"description": "string", "source": "string"})
    return out.select("row_id", "date", "cents", "description", "source")


@query("p3_drop_zero", "SELECT c_custkey FROM customer WHERE abs(round(c_acctbal / 100000, 2)) > 0.009")
def p3(spark, sf):
    cust = table(spark, sf, "customer").withColumn("amount", F.round(c("c_acctbal") / 100000, 2))
    return P.drop_zero(cust).select("c_custkey")


@query("p5_drop_fees", f"{MOVES} SELECT row_id FROM mov WHERE prio <> 'URGENT'")
def p5(spark, sf):
    mov = movements(spark, sf).withColumn("description", F.when(c("prio") == "URGENT", T("Débito TARIFA", c("memo"))).otherwise(c("memo")))
    return P.drop_fees(mov).select("row_id")


@query("p7_filter_entries", f"{MOVES} SELECT row_id FROM mov WHERE contains(lower(memo), 'n12')")
def p7(spark, sf):
    return P.filter_entries(movements(spark, sf).withColumnRenamed("memo", "description"), "N12").select("row_id")


@query("p8_filter_company", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00012') OR contains(CAST(c_custkey * 7919 AS VARCHAR), '00012')")
def p8(spark, sf):
    cust = table(spark, sf, "customer").withColumn("tax_id", (c("c_custkey") * 7919).cast("string"))
    return P.filter_company(cust, "00012", "c_name").select("c_custkey")


@query("p9_find_amount", f"{SIDES} SELECT row_id FROM ledger WHERE abs(cents) = 37035 UNION ALL SELECT row_id FROM ledger WHERE date = DATE '1997-03-31' AND contains(lower(description), 'high')")
def p9(spark, sf):
    led = with_amount(ledger_of(spark, sf))
    return P.find_amount(led, 370.35).select("row_id").unionByName(P.find_on_day(led, "1997-03-31", "High").select("row_id"))


@query("p10_normalise", f"{RAWS} SELECT pos, CASE WHEN prio = 'HIGH' THEN NULL ELSE real_date END AS date, CASE WHEN prio = 'LOW' THEN 0 ELSE abs(cents) END AS cents FROM raw")
def p10(spark, sf):
    raw = raw_ledger(spark, sf).withColumn("date", F.regexp_replace("date", r"(\d{2})/(\d{2})/(\d{4})", "$3-$2-$1"))
    return P.normalise_transactions(raw).select("pos", "date", S.to_cents("amount").alias("cents"))


def statement(spark, sf) -> DataFrame:
    """TXN rows of the statements with their place as internal id."""
    return movements(spark, sf).select(
        "file", "page_no", (c("slot") * 10).alias("line_no"), (c("row_id") % 1000).alias("internal_id"), "date", S.from_cents("cents").alias("amount"), "memo",
        F.when(c("neg"), "DEBIT").otherwise("CREDIT").alias("type"), F.lit(None).cast("string").alias("doc_id"),
        F.lit(None).cast(MONEY).alias("balance"), c("row_id"), c("prio"))


def file_sums(txn: DataFrame) -> DataFrame:
    return txn.groupBy("file").agg(F.lit(0).cast(MONEY).alias("bal_start"), F.sum("amount").cast(MONEY).alias("bal_end"))


@query("p11_flip_statement", f"""{MOVES}, f AS (SELECT file, max(row_id) AS last_id, sum(cents) AS total FROM mov GROUP BY 1)
SELECT m.file, m.row_id, f.last_id - m.row_id AS internal_id, CAST(f.total - l.cents AS BIGINT) AS bal_start, CAST(0 AS BIGINT) AS bal_end
FROM mov m JOIN f USING (file) JOIN mov l ON l.row_id = f.last_id""")
def p11(spark, sf):
    txn = statement(spark, sf)
    flipped, fixed = P.flip_statement(txn, file_sums(txn))
    return flipped.select("file", "row_id", "internal_id").join(balance_cents(fixed, "file"), "file")


@query("p12_flatten_audit", f"{MOVES} SELECT file, date, cents, memo FROM mov")
def p12(spark, sf):
    txn = movements(spark, sf)
    audit = txn.groupBy("file", "page_no").agg(F.collect_list(F.struct("date", "cents", "memo")).alias("transactions"))
    return P.flatten_audit(audit)


# ---- deduplication and set operations ------------------------------------------------------------

@query("d1_dedup_statement", f"""{MOVES}, u AS (SELECT *, page_no AS p FROM mov UNION ALL SELECT *, page_no + 1 FROM mov WHERE slot >= 30 AND prio = 'URGENT')
SELECT file, memo, cents, row_number() OVER (PARTITION BY file ORDER BY min(p), slot, date, cents, memo) - 1 AS internal_id FROM u GROUP BY file, memo, cents, slot, date""")
def d1(spark, sf):
    txn = statement(spark, sf).drop("internal_id")
    again = txn.filter((c("line_no") >= 300) & (c("prio") == "URGENT")).withColumn("page_no", c("page_no") + 1)
    return P.dedup_statement(txn.unionByName(again)).select("file", "memo", S.to_cents("amount").alias("cents"), "internal_id")


@query("d2_consolidate", f"""{MOVES} SELECT file AS source_file, row_id % 1000 AS internal_id, date, cents, trim(CASE WHEN prio = 'LOW' THEN '' ELSE memo END) AS description FROM mov
UNION ALL SELECT file, NULL, date, cents, trim(CASE WHEN prio = 'LOW' THEN '' ELSE memo END) FROM mov WHERE cents > 0""")
def d2(spark, sf):
    rows = statement(spark, sf).select(c("file").alias("source_file"), "internal_id", "date", "amount",
                                       F.when(c("prio") != "LOW", F.concat(F.lit(" "), c("memo"), F.lit(" "))).alias("description"))
    # the same ids again with other contents, and rows of a source that has no ids
    out = P.consolidate([rows, rows.filter("amount < 0").withColumn("description", F.lit("AAA")), rows.filter("amount > 0").drop("internal_id")])
    return out.select("source_file", "internal_id", "date", S.to_cents("amount").alias("cents"), "description")


@query("d2_consolidate_by_content", f"{SIDES} SELECT date, cents, description, min(row_id) AS row_id FROM ledger GROUP BY 1, 2, 3")
def d2b(spark, sf):
    led = with_amount(ledger_of(spark, sf)).withColumn("internal_id", c("row_id"))
    return P.consolidate([led, led], key="content").select("date", S.to_cents("amount").alias("cents"), "description", "row_id")


@query("d4_duplicates", f"{SIDES} SELECT row_id, copies FROM (SELECT *, count(*) OVER (PARTITION BY date, cents, description) AS copies FROM ledger) WHERE copies > 1")
def d4(spark, sf):
    return P.duplicates(ledger_of(spark, sf), ["date", "cents", "description"]).select("row_id", "copies")


@query("d5_extraction_diff", f"""{SIDES}, a AS (SELECT DISTINCT date, cents FROM ledger), b AS (SELECT DISTINCT date, cents FROM bank)
SELECT date, cents, 'a' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT date, cents, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def d5(spark, sf):
    out = P.extraction_diff(with_amount(ledger_of(spark, sf)), with_amount(orders_bank(spark, sf)))
    return out.select("date", S.to_cents("amount").alias("cents"), "only_in")


# ---- ledger --------------------------------------------------------------------------------------

@query("s2_type_ledger", f"{RAWS} SELECT file, pos, real_date AS date, CASE WHEN prio = 'LOW' THEN 0 ELSE abs(cents) END AS cents FROM raw WHERE prio <> 'HIGH'")
def s2(spark, sf):
    return L.type_ledger(raw_ledger(spark, sf)).select("file", "pos", "date", S.to_cents("amount").alias("cents"))


@query("s3_clean_ledger_amount", f"""{MOVES} SELECT file, row_id, CASE WHEN max(row_id % 1000 = 7) OVER (PARTITION BY file) THEN abs(cents) * (CASE WHEN row_id % 1000 = 7 THEN 1 ELSE 100 END)
  ELSE abs(cents) END AS cents FROM mov""")
def s3(spark, sf):
    plain = F.abs(S.from_cents("cents")).cast("string")
    txt = F.when(c("row_id") % 1000 == 7, c("mag_txt")).otherwise(F.concat(F.lit("  "), plain))
    mov = movements(spark, sf).withColumn("Valor", txt)
    return L.clean_ledger_amount(mov, "Valor", ["file"]).select("file", "row_id", S.to_cents("Valor").alias("cents"))


SIGNS = """, sides AS (SELECT file, debit_account AS a FROM raw UNION ALL SELECT file, credit_account FROM raw),
freq AS (SELECT file, a, count(*) AS n FROM sides WHERE a NOT IN ('', '0', 'nan') GROUP BY 1, 2),
acct AS (SELECT file, a AS bank_account FROM freq QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, a) = 1)"""


@query("a8_infer_bank_account", f"{RAWS}{SIGNS} SELECT * FROM acct")
def a8(spark, sf):
    return L.infer_bank_account(raw_ledger(spark, sf), ["file"])


@query("a9_ledger_sign", f"{RAWS} SELECT file, pos, CASE WHEN prio = 'LOW' THEN 0 ELSE cents END AS cents FROM raw WHERE prio <> 'HIGH'")
def a9(spark, sf):
    return L.to_ledger(raw_ledger(spark, sf), ["file"]).select("file", "pos", S.to_cents("amount").alias("cents"))


@query("a10_account_profile", f"""{RAWS}, u AS (SELECT file, debit_account AS account, 1 AS d, 0 AS k FROM raw UNION ALL SELECT file, credit_account, 0, 1 FROM raw)
SELECT file, account, count(*) AS uses, CAST(sum(d) AS BIGINT) AS debits, CAST(sum(k) AS BIGINT) AS credits, row_number() OVER (PARTITION BY file ORDER BY count(*) DESC, account) AS place
FROM u GROUP BY 1, 2 QUALIFY place <= 5""")
def a10(spark, sf):
    raw = raw_ledger(spark, sf).withColumn("amount", F.lit(0))
    return L.account_profile(raw, ["file"]).drop("negatives")


@query("a10_sample_rows", f"{RAWS} SELECT file, pos, row_number() OVER (PARTITION BY file ORDER BY pos) AS place FROM raw WHERE credit_account = '78' QUALIFY place <= 5")
def a10b(spark, sf):
    raw = raw_ledger(spark, sf)
    return L.sample_rows(raw, L.infer_bank_account(raw, ["file"]), ["file"]).select("file", "pos", "place")


# ---- balances ------------------------------------------------------------------------------------

def broken(spark, sf):
    """Statements with page-sized files: the first row of URGENT-led pages flipped, that of HIGH-led pages put aside."""
    txn = statement(spark, sf).withColumn("file", T(c("file"), c("page_no").cast("string")))
    lead = (c("line_no") == 0) & (c("row_id") % 40 == 0)
    flip, ghost = lead & (c("prio") == "URGENT"), lead & (c("prio") == "HIGH")
    bal = file_sums(txn).withColumn("bal_end", F.when(F.col("file").contains(" 3"), None).otherwise(F.col("bal_end")))
    shown = txn.withColumn("amount", F.when(flip, -c("amount")).otherwise(c("amount")).cast(MONEY))
    shown = shown.withColumn("type", F.when(c("amount") < 0, "DEBIT").otherwise("CREDIT"))
    return shown.filter(~ghost), txn.filter(ghost), bal


BROKEN = f"""{MOVES}, f AS (SELECT file || ' ' || page_no AS file, sum(cents) AS total, max(prio) FILTER (WHERE slot = 0) AS lead, max(cents) FILTER (WHERE slot = 0) AS lead_cents,
  CASE WHEN contains(any_value(file || ' ' || page_no), ' 3') THEN NULL ELSE sum(cents) END AS bal_end FROM mov GROUP BY file, page_no),
g AS (SELECT *, CASE lead WHEN 'URGENT' THEN 2 * lead_cents WHEN 'HIGH' THEN lead_cents ELSE 0 END AS diff FROM f)"""


@query("a3_validate_balance", f"""{BROKEN} SELECT file, diff = 0 AND bal_end IS NOT NULL OR CASE WHEN bal_end IS NULL THEN NULL ELSE false END AS is_valid,
  CASE WHEN bal_end IS NOT NULL THEN CAST(abs(diff) AS BIGINT) END AS diff,
  CASE WHEN bal_end IS NULL THEN 'Saldo Inicial/Final não detectado.' WHEN diff = 0 THEN 'Conciliação Perfeita! ✅' ELSE format('❌ Divergência: Calc: {{:.2f}} | Real: {{:.2f}} | Diff: {{:.2f}}',
    CAST((total - diff) / 100.0 AS DOUBLE), CAST(total / 100.0 AS DOUBLE), CAST(abs(diff) / 100.0 AS DOUBLE)) END AS msg FROM g""")
def a3(spark, sf):
    txn, _, bal = broken(spark, sf)
    return B.validate_balance(txn, bal).select("file", "is_valid", S.to_cents("diff").alias("diff"), "msg")


FIXED = "SELECT m.file || ' ' || m.page_no AS file, row_id, {} AS cents FROM mov m JOIN g ON g.file = m.file || ' ' || m.page_no"


@query("a4_repair_sign_flip", f"""{BROKEN} {FIXED.format("CASE WHEN slot = 0 AND lead = 'URGENT' AND bal_end IS NULL THEN -cents ELSE cents END")} WHERE NOT (slot = 0 AND lead = 'HIGH')""")
def a4(spark, sf):
    txn, _, bal = broken(spark, sf)
    return B.repair_sign_flip(txn, bal).select("file", "row_id", S.to_cents("amount").alias("cents"))


@query("a5_repair_ghost", f"""{BROKEN} {FIXED.format("CASE WHEN slot = 0 AND lead = 'URGENT' THEN -cents ELSE cents END")} WHERE NOT (slot = 0 AND lead = 'HIGH' AND bal_end IS NULL)""")
def a5(spark, sf):
    txn, gone, bal = broken(spark, sf)
    return B.repair_ghost(txn, gone, bal).select("file", "row_id", S.to_cents("amount").alias("cents"))


@query("a6_auto_repair_rows", f"""{BROKEN} {FIXED.format("CASE WHEN slot = 0 AND lead = 'URGENT' AND bal_end IS NULL THEN -cents ELSE cents END")} WHERE NOT (slot = 0 AND lead = 'HIGH' AND bal_end IS NULL)""")
def a6(spark, sf):
    return B.auto_repair(*broken(spark, sf))[0].select("file", "row_id", S.to_cents("amount").alias("cents"))


@query("a6_auto_repair_status", f"""{BROKEN} SELECT file, CASE WHEN bal_end IS NULL THEN NULL ELSE true END AS is_valid,
  CASE WHEN bal_end IS NOT NULL AND lead IN ('URGENT', 'HIGH') THEN 'Text (Auto-Corrected)' ELSE 'Text' END AS method FROM g""")
def a6b(spark, sf):
    return B.auto_repair(*broken(spark, sf))[1].select("file", "is_valid", "method")


@query("a7_daily_gap", f"""{MOVES}, d AS (SELECT file, date, sum(cents) AS net FROM mov GROUP BY 1, 2), e AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY date DESC) = 1 AS last FROM d),
n AS (SELECT file, date, CAST(CASE WHEN last THEN 500000 - net ELSE -net END AS BIGINT) AS cents FROM e)
SELECT file, date, cents, 'System' AS source, 'Rende Fácil - Movimentação Automática' AS memo FROM n WHERE abs(cents) > 1
UNION ALL SELECT file, date, cents, 'Bank', memo FROM mov""")
def a7(spark, sf):
    txn = statement(spark, sf).select("file", "date", "amount", "memo")
    bal = txn.select("file").distinct().select("file", F.lit(1000).cast(MONEY).alias("bal_start"), F.lit(6000).cast(MONEY).alias("bal_end"))
    return B.inject_daily_gap(txn, bal).select("file", "date", S.to_cents("amount").alias("cents"), "source", "memo")


@query("a18_extraction_audit", f"""{BROKEN}, c AS (SELECT file || ' ' || page_no AS file, any_value(['001', '104', '777', '']) AS codes, CAST(page_no % 4 + 1 AS INTEGER) AS i, count(*) AS n FROM mov GROUP BY file, page_no)
SELECT file, CASE WHEN i = 3 THEN 'error' WHEN diff <> 0 AND bal_end IS NOT NULL THEN 'warning' ELSE 'success' END AS status,
  CASE codes[i] WHEN '001' THEN 'Banco do Brasil S.A. (001)' WHEN '104' THEN 'Caixa Econômica Federal (104)' WHEN '' THEN 'Não Detectado' ELSE 'Banco Desconhecido (777)' END AS bank,
  n - CASE WHEN lead = 'HIGH' THEN 1 ELSE 0 END AS tx_count FROM c JOIN g USING (file)""")
def a18(spark, sf):
    txn, _, bal = broken(spark, sf)
    codes = F.array(F.lit("001"), F.lit("104"), F.lit("777"), F.lit(""))
    pages = statement(spark, sf).select(T(c("file"), c("page_no").cast("string")).alias("file"), (c("page_no") % 4 + 1).cast("int").alias("i")).distinct()
    catalog = pages.select("file", F.when(c("i") == 3, "doc").otherwise("pdf").alias("suffix"), F.element_at(codes, c("i")).alias("bank_id"))
    return B.extraction_audit(catalog, txn, bal, banks_dim(spark)).select("file", "status", "bank", "tx_count")


@query("a19_deep_verify", f"""{BROKEN}, r AS (SELECT m.file || ' ' || m.page_no AS file, date, prio, CASE WHEN slot = 0 AND prio = 'URGENT' THEN -cents ELSE cents END AS cents
  FROM mov m WHERE NOT (slot = 0 AND prio = 'HIGH')), k AS (SELECT *, count(*) OVER (PARTITION BY file, date, prio, cents) AS copies FROM r)
SELECT k.file, count(*) AS txns, count(*) FILTER (WHERE copies > 1) AS duplicates, CASE WHEN any_value(bal_end) IS NULL THEN NULL ELSE CAST(any_value(g.diff) AS BIGINT) END AS discrepancy,
  CASE WHEN any_value(bal_end) IS NOT NULL AND abs(any_value(g.diff)) < 5 THEN 'PASS' ELSE 'CHECK (Bal mismatch or no info)' END AS status FROM k JOIN g USING (file) GROUP BY 1""")
def a19(spark, sf):
    txn, _, bal = broken(spark, sf)
    out = B.deep_verify(txn.withColumn("memo", F.lower("prio")), bal)
    return out.select("file", "txns", "duplicates", S.to_cents("discrepancy").alias("discrepancy"), "status")


def audit_lines(spark, sf):
    torn = c("row_id") % 13 == 0
    line = F.when(torn, T(date_br(), c("memo"))).otherwise(T(date_br(), c("memo"), c("mag_txt"), c("dc")))
    return to_lines(movements(spark, sf), [line], [F.lit("01/01/2025 Saldo Anterior 5,00 C"), F.lit("EXTRATO")])


@query("a20_coverage_counts", f"""{MOVES}, n AS (SELECT file, count(*) AS candidates, count(*) FILTER (WHERE row_id % 13 <> 0) + count(DISTINCT page_no) AS parsed FROM mov GROUP BY 1)
SELECT file, candidates, parsed, candidates = parsed AS matches FROM n""")
def a20(spark, sf):
    """The rule reads the opening line of each page as a row, which is no candidate: the audit shows it."""
    lines = audit_lines(spark, sf)
    return B.coverage_audit(lines, extract_simple(lines, 2025))[0]


@query("a20_coverage_missing", f"{MOVES} SELECT file, page_no, strftime(date, '%d/%m/%Y') || ' ' || memo AS text FROM mov WHERE row_id % 13 = 0")
def a20b(spark, sf):
    lines = audit_lines(spark, sf)
    return B.coverage_audit(lines, extract_simple(lines, 2025))[1].select("file", "page_no", "text")


@query("a21_null_audit", f"{RAWS} SELECT file, count(*) FILTER (WHERE prio = 'HIGH') AS null_date, CAST(0 AS BIGINT) AS null_amount, CAST(0 AS BIGINT) AS null_memo FROM raw GROUP BY 1")
def a21(spark, sf):
    raw = raw_ledger(spark, sf).withColumn("date", S.parse_date("date")).withColumnRenamed("description", "memo")
    return B.null_audit(raw)


@query("a22_load_status", f"""WITH {LEDGER}, {BANK}, n AS (SELECT account_id, f AS ledger_name, row_number() OVER (PARTITION BY account_id ORDER BY f) AS place FROM (SELECT DISTINCT account_id, description AS f FROM ledger))
SELECT account_id, ledger_count, coalesce(bank_count, 0) AS bank_count, ledger_name, place FROM (SELECT account_id, count(*) AS ledger_count FROM ledger GROUP BY 1)
  LEFT JOIN (SELECT account_id, count(*) AS bank_count FROM bank GROUP BY 1) USING (account_id) JOIN n USING (account_id)""")
def a22(spark, sf):
    led = ledger_of(spark, sf).withColumn("source_file", c("description"))
    return B.load_status(led, orders_bank(spark, sf), ["account_id"])


@query("a23_activity_stats", """SELECT CAST(user_id AS VARCHAR) AS "user", event_type AS category, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def a23(spark, sf):
    log = table(spark, sf, "events").select(c("ts").alias("timestamp"), c("user_id").cast("string").alias("user"), c("event_type").alias("category"))
    return activity_stats(log)


@query("a25_ingest_errors", f"""{MOVES} SELECT DISTINCT file || ' ' || page_no AS file, CASE WHEN page_no % 5 = 0 THEN 'Not found: ' ELSE 'No transactions found for ' END || file || ' ' || page_no AS error
FROM mov WHERE page_no % 5 IN (0, 1)""")
def a25(spark, sf):
    txn = statement(spark, sf).withColumn("file", T(c("file"), c("page_no").cast("string")))
    catalog = txn.select("file", (c("page_no") % 5 != 0).alias("found")).distinct()
    return B.ingest_errors(catalog, txn.filter(~(c("page_no") % 5).isin(0, 1)))


# ---- journal -------------------------------------------------------------------------------------

def entries_of(spark, sf) -> DataFrame:
    """Every id stands in two accounts; some entries have no date."""
    rows = with_amount(orders_bank(spark, sf)).withColumn("date", F.when(c("row_id") % 31 != 0, c("date")))
    rows = rows.select(F.concat(F.lit("bank_"), c("row_id").cast("string")).alias("id"), "date", "amount", "description", "account_id")
    return rows.unionByName(rows.withColumn("account_id", c("account_id") + 1000))


def edits_of(spark, sf) -> DataFrame:
    """Two versions of the debit account and one document per edited row; the second account's entries are not edited."""
    rows = orders_bank(spark, sf).filter(c("row_id") % 7 == 0).select("account_id", F.concat(F.lit("bank_"), c("row_id").cast("string")).alias("id"), "row_id")
    versions = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value"), F.lit(s).cast("bigint").alias("seq")) for f, v, s in (
        ("conta_debito", F.lit("100"), 1), ("conta_debito", F.concat(F.lit("20"), c("row_id").cast("string")), 2), ("documento", F.lit("D9"), 3))])
    return rows.select("account_id", "id", F.inline(versions))


ENTRIES = f"""{SIDES}, twice AS (SELECT account_id, row_id, date, cents, description, row_id % 7 = 0 AS ed FROM bank UNION ALL SELECT account_id + 1000, row_id, date, cents, description, false FROM bank),
ent AS (SELECT 'bank_' || row_id AS id, CASE WHEN row_id % 31 = 0 THEN NULL ELSE date END AS date, cents, description, CASE WHEN ed THEN '20' || row_id ELSE '78' END AS conta_debito, '' AS participante_debito,
  '6670' AS conta_credito, '' AS participante_credito, CASE WHEN ed THEN 'D9' ELSE '001' END AS documento, 'bank' AS source, ed AS is_edited, row_id, account_id FROM twice)"""
ENTRY_COLS = "account_id, id, date, cents, description, conta_debito, participante_debito, conta_credito, participante_credito, documento, source, is_edited"


def entry_cents(df: DataFrame) -> DataFrame:
    return df.withColumn("cents", S.to_cents("amount")).drop("amount")


def overlaid(spark, sf) -> DataFrame:
    return J.overlay_edits(entries_of(spark, sf), edits_of(spark, sf), ["account_id"])


@query("j10_overlay_edits", f"{ENTRIES} SELECT {ENTRY_COLS} FROM ent")
def j10(spark, sf):
    return entry_cents(overlaid(spark, sf))


def manual_log(spark, sf) -> DataFrame:
    """Every ledger row is added by hand, every second one added again later, pending ones deleted last, in one of two accounts with the same ids."""
    led = with_amount(ledger_of(spark, sf))
    base = led.select("account_id", "row_id", F.concat(F.lit("manual_"), c("row_id").cast("string")).alias("id"), "date", "amount", "description", F.lit("10").alias("conta_debito"),
                      F.lit(None).cast("string").alias("participante_debito"), F.lit("20").alias("conta_credito"), F.lit("P1").alias("participante_credito"),
                      F.when(c("row_id") % 3 == 0, "X7").otherwise("").alias("documento"))
    first = base.withColumn("op", F.lit("add")).withColumn("seq", F.lit(1))
    second = base.filter(c("row_id") % 2 == 0).withColumn("op", F.lit("add")).withColumn("seq", F.lit(2)).withColumn("conta_debito", F.lit("11"))
    gone = base.filter(c("description") == "5-LOW").withColumn("op", F.lit("delete")).withColumn("seq", F.lit(3))
    other = first.withColumn("account_id", c("account_id") + 1000)
    return first.unionByName(second).unionByName(gone).unionByName(other).drop("row_id")


MANUAL = f"""by_hand AS (SELECT *, row_id % 2 = 0 AS again FROM ledger WHERE description <> '5-LOW' UNION ALL SELECT * REPLACE (account_id + 1000 AS account_id), false FROM ledger),
man AS (SELECT 'manual_' || row_id AS id, date, cents, description, CASE WHEN again THEN '11' ELSE '10' END AS conta_debito, '' AS participante_debito, '20' AS conta_credito,
  'P1' AS participante_credito, CASE WHEN row_id % 3 = 0 THEN 'X7' ELSE '001' END AS documento, 'manual' AS source, false AS is_edited, row_id, account_id FROM by_hand)"""


@query("j12_manual_log", f"{SIDES}, {MANUAL} SELECT {ENTRY_COLS} FROM man")
def j12(spark, sf):
    return entry_cents(J.apply_manual_log(manual_log(spark, sf), ["account_id"]))


@query("d6_all_entries", f"{ENTRIES}, {MANUAL} SELECT {ENTRY_COLS} FROM ent UNION ALL SELECT {ENTRY_COLS} FROM man")
def d6(spark, sf):
    return entry_cents(P.all_entries(overlaid(spark, sf), J.apply_manual_log(manual_log(spark, sf), ["account_id"])))


def chosen_ids(spark, sf) -> DataFrame:
    return orders_bank(spark, sf).filter("cents > 0").select("account_id", F.concat(F.lit("bank_"), c("row_id").cast("string")).alias("id"))


@query("j11_select_entries", f"{ENTRIES} SELECT account_id, id, cents FROM ent WHERE cents > 0 AND account_id < 1000")
def j11(spark, sf):
    return entry_cents(J.select_entries(overlaid(spark, sf), chosen_ids(spark, sf), ["account_id"])).select("account_id", "id", "cents")


@query("a24_entry_counters", f"""{ENTRIES}, {MANUAL} SELECT account_id, count(*) FILTER (WHERE source = 'bank') AS bank, count(*) FILTER (WHERE source = 'manual') AS manual,
  count(*) FILTER (WHERE source = 'bank' AND cents > 0 AND account_id < 1000) AS selected FROM (SELECT account_id, source, cents FROM ent UNION ALL SELECT account_id, source, cents FROM man) GROUP BY 1""")
def a24b(spark, sf):
    from tallybook.operators.report import entry_counters
    return entry_counters(P.all_entries(overlaid(spark, sf), J.apply_manual_log(manual_log(spark, sf), ["account_id"])), chosen_ids(spark, sf), ["account_id"])


@query("k1_journal_lines", f"""{ENTRIES}, n AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date, id) AS n FROM ent)
SELECT account_id, n, n || ',' || coalesce(strftime(date, '%d/%m/%Y'), '') || ',' || conta_debito || ',,' || conta_credito || ',,' || CAST(CAST(cents / 100.0 AS DECIMAL(18,2)) AS VARCHAR) || ',,' || description ||
  ',DCTO,,' || documento AS line FROM n""")
def k1(spark, sf):
    return J.to_journal_lines(overlaid(spark, sf), ["account_id"])


@query("k2_journal_file_name", "SELECT c_custkey, 'lancamento_' || upper(replace(c_name || ' ltda', ' ', '')) || '_' || (c_custkey % 12 + 1) || '2025 BANCO.txt' AS file_name FROM customer")
def k2(spark, sf):
    name = J.journal_file_name(F.concat("c_name", F.lit(" ltda")), c("c_custkey") % 12 + 1, F.lit(2025), F.lit("BANCO"))
    return table(spark, sf, "customer").select("c_custkey", name.alias("file_name"))


# ---- ordering helpers ----------------------------------------------------------------------------

@query("w7_carry_last", f"""{MOVES} SELECT row_id, last_value(CASE WHEN slot % 7 = 3 THEN date END IGNORE NULLS) OVER (
  PARTITION BY file ORDER BY page_no, slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM mov""")
def w7(spark, sf):
    rows = movements(spark, sf).select("row_id", "file", "page_no", "slot", "date")
    return O.carry_last(rows, ["file"], "page_no", ["slot"], {"seen": F.when(c("slot") % 7 == 3, c("date"))}).select("row_id", "seen")


@query("w8_running_count", f"""{MOVES} SELECT row_id, count(*) FILTER (WHERE prio = 'URGENT') OVER (
  PARTITION BY file ORDER BY page_no, slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM mov""")
def w8(spark, sf):
    rows = movements(spark, sf).select("row_id", "file", "page_no", "slot", "prio")
    return O.running_count(rows, ["file"], "page_no", ["slot"], c("prio") == "URGENT", "n").select("row_id", "n")
