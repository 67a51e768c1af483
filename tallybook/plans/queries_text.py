"""Statement rules over statements that Spark prints from the orders table; the SQL reads the orders back."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions import words as W
from tallybook.functions.scalars import fmt_brl, from_cents, is_continuation, should_ignore, to_cents
from tallybook.operators import extract_lines as X
from tallybook.operators import extract_words as V
from tallybook.operators.balance import file_balances
from tallybook.operators.clean import grep_context
from tallybook.plans.fixtures import date_br, dealt, movements, table, to_lines, to_words
from tallybook.plans.extract import extract_statements
from tallybook.plans.registry import MOVES, query
from tallybook.sources.catalog import bank_label, bank_name, detect_layout, identify, route, shipped_layouts, with_sublayout
from tallybook.sources.texts import page_lines

DOT_LAYOUT = {
    "name": "Dotted", "bank_id": "999", "keywords": ["Extrato"],
    "line_pattern": r"^(\d{2}\.\d{2}\.\d{4})\s+(.+?)\s+([\d\.]+,\d{2})\s+([CD])",
    "columns": [{"name": n, "match_group": i} for i, n in enumerate(["date", "memo", "amount", "type"], 1)],
    "date_format": "%d.%m.%Y", "has_balance_cleanup": True,
    "balance_start_pattern": r"(Saldo Anterior)\s+([\d\.]+,\d{2})", "balance_end_pattern": r"(Saldo Atual)\s+([\d\.]+,\d{2})",
}
DUAL_LAYOUT = {
    "name": "Dual", "bank_id": "888", "keywords": ["Dual"], "line_pattern": r"(\d{2}/\d{2}/\d{4})\s+(.+?);([\d,]*\.?\d*);([\d,]*\.?\d*)$",
    "columns": [{"name": n, "match_group": i} for i, n in enumerate(["date", "memo", "amount_debit", "amount_credit"], 1)],
    "amount_decimal_separator": ".", "amount_thousand_separator": ",", "date_format": "%d/%m/%Y",
}
ABOVE_LAYOUT = {
    "name": "Cresol", "bank_id": "133", "keywords": ["Cresol"], "line_pattern": r"(\d{2}/\d{2}/\d{4})\s+([\d\.]+,\d{2})\s+([CD])",
    "columns": [{"name": "date", "match_group": 1}, {"name": "amount", "match_group": 2}, {"name": "type", "match_group": 3}],
}


def T(*parts):
    """Words joined by a blank; plain strings are text."""
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def c(name: str):
    return F.col(name)


def rows_out(txn: DataFrame, *extra) -> DataFrame:
    return txn.select("file", "page_no", "date", to_cents("amount").alias("cents"), "memo", *extra)


def rest_line():
    """A continuation line under one row in four."""
    return F.when(c("row_id") % 4 == 0, T("REF", c("cust").cast("string"), "DETALHE"))


REST_SQL = "memo || CASE WHEN row_id % 4 = 0 THEN ' REF ' || cust || ' DETALHE' ELSE '' END"
ROWS = f"{MOVES} SELECT file, page_no, date, cents, memo FROM mov"
ROWS_REST = f"{MOVES} SELECT file, page_no, date, cents, {REST_SQL} AS memo FROM mov"


def dot_lines(spark, sf) -> DataFrame:
    mov = movements(spark, sf)
    body = [F.when(c("row_id") % 7 == 0, T(date_br("dd.MM.yyyy"), "SALDO DO DIA 1.000,00 C")),
            T(date_br("dd.MM.yyyy"), c("memo"), c("mag_txt"), c("dc")), rest_line()]
    return to_lines(mov, body, [F.lit("EXTRATO DE CONTA"), F.lit("Saldo Anterior 1.000,00")],
                    [F.lit("Saldo Atual 1.150,00"), F.lit("OUVIDORIA 0800")])


@query("x1_generic", f"""{MOVES} SELECT file, page_no, date, cents, {REST_SQL} AS memo, CASE WHEN neg THEN 'DEBIT' ELSE 'CREDIT' END AS type,
  strftime(date, '%Y%m%d') || abs(cents) AS fitid FROM mov""")
def x1(spark, sf):
    return rows_out(X.extract_generic(dot_lines(spark, sf), DOT_LAYOUT)[0], "type", "fitid")


@query("x4_discarded", f"{MOVES} SELECT file, page_no, date, CAST(100000 AS BIGINT) AS cents, 'SALDO DO DIA' AS memo FROM mov WHERE row_id % 7 = 0")
def x4(spark, sf):
    return rows_out(X.extract_generic(dot_lines(spark, sf), DOT_LAYOUT)[1])


def dual_lines(spark, sf):
    amount = F.format_number(F.abs(from_cents("cents")), 2)
    return to_lines(movements(spark, sf), [F.concat_ws(";", T(date_br(), c("memo")), F.when(c("neg"), amount).otherwise(""),
                                                           F.when(~c("neg"), amount).otherwise(""))], [F.lit("DATA HISTORICO DEBITO CREDITO")])


@query("x2_map_fields", f"{MOVES} SELECT file, page_no, date, cents, memo, CASE WHEN neg THEN 'DEBIT' ELSE 'CREDIT' END AS type FROM mov")
def x2(spark, sf):
    return rows_out(X.map_fields(dual_lines(spark, sf), DUAL_LAYOUT).filter("is_match"), "type")


@query("x3_fitid", f"{MOVES} SELECT file, page_no, CAST(slot * 10 + CASE WHEN slot = 0 THEN 1 ELSE 0 END AS INTEGER) AS line_no, strftime(date, '%Y%m%d') || abs(cents) AS fitid FROM mov")
def x3(spark, sf):
    return X.map_fields(dual_lines(spark, sf), DUAL_LAYOUT).filter("is_match").select("file", "page_no", "line_no", "fitid")


def doc_lines(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select(c("doc_id").cast("string").alias("file"), F.lit(1).alias("page_no"), "text", "lang")
    return page_lines(docs)


DOC_LINES = """WITH l AS (SELECT file, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS text FROM (
  SELECT CAST(doc_id AS VARCHAR) AS file, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""


def _alt(words):
    return "|".join(w.replace(".", r"\.") for w in words)


@query("x5_continuation", f"""{DOC_LINES}, s AS (SELECT file, line_no, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM l)
SELECT file, CAST(count(*) FILTER (WHERE length(t) >= 3 AND NOT regexp_matches(t, '====|-----|_____')
  AND NOT regexp_matches(upper(replace(t, 'ß', 'ss')), '{_alt(W.CONTINUATION_BLOCK)}') AND NOT contains(t, '**/**/****') AND NOT starts_with(t, '...')) AS BIGINT) AS n,
  count(*) AS total FROM s GROUP BY file""")
def x5(spark, sf):
    return doc_lines(spark, sf).groupBy("file").agg(F.count_if(is_continuation("text")).alias("n"), F.count("*").alias("total"))


@query("x8_ignored_lines", f"""{DOC_LINES} SELECT file, CAST(count(*) FILTER (WHERE text = '' OR regexp_matches(upper(replace(text, 'ß', 'ss')), '{_alt(W.IGNORED_LINE)}')
  OR regexp_matches(text, '\\b0,00\\s*[DC]?\\b|\\b0\\.00\\s*[DC]?\\b')) AS BIGINT) AS n FROM l GROUP BY file""")
def x8(spark, sf):
    return doc_lines(spark, sf).groupBy("file").agg(F.count_if(should_ignore("text")).alias("n"))


@query("x24_grep_context", f"""{DOC_LINES}, m AS (SELECT *, contains(text, 'data') AS hit FROM l),
w AS (SELECT *, max(hit) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM m)
SELECT file, line_no, hit AS is_match, CAST(length(text) AS INTEGER) AS n FROM w WHERE near""")
def x24(spark, sf):
    return grep_context(doc_lines(spark, sf), "data", 3).select("file", "line_no", "is_match", F.length("text").alias("n"))


@query("x6_memo_above", f"""{MOVES} SELECT file, page_no, date, cents,
  CASE WHEN row_id % 5 = 0 OR row_id % 11 = 0 THEN 'Descrição não capturada' ELSE memo END AS memo FROM mov""")
def x6(spark, sf):
    above = F.when(c("row_id") % 11 != 0, F.when(c("row_id") % 5 == 0, F.lit("Histórico do lançamento")).otherwise(c("memo")))
    lines = to_lines(movements(spark, sf), [above, F.lit("  "), T(date_br(), c("mag_txt"), c("dc"))])
    return rows_out(X.extract_memo_above(lines, ABOVE_LAYOUT))


def smart_words(spark, sf):
    mov = movements(spark, sf)
    months = F.element_at(F.array(*[F.lit(m) for m in W.MONTHS]), F.month("date"))
    day = F.when(c("row_id") % 6 == 0, F.concat(F.date_format("date", "dd"), F.lit("/"), months, F.lit("/"), F.date_format("date", "yyyy"))).otherwise(date_br())
    bal = fmt_brl(from_cents(c("row_id") * 100 + 7))
    return to_words(mov, [(40, F.when(c("slot") == 0, F.lit("SALDO ANTERIOR 1.000,00 C")), 0), (60, F.when(c("row_id") % 3 != 0, c("memo")), 1),
                          (30, day, 2), (300, F.lit("TRANSACAO"), 2), (400, c("mag_txt"), 2), (410, c("dc"), 2), (500, bal, 2)])


BR = "translate(format('{:,.2f}', CAST({} AS DOUBLE)), ',.', '.,')"
BR_ABS = "translate(format('{:,.2f}', abs(cents) / 100.0), ',.', '.,')"


@query("x7_smart", f"""{MOVES}, t AS (SELECT *, strftime(date, '%d') || CASE WHEN row_id % 6 = 0 THEN '/' || ['JAN','FEV','MAR','ABR','MAI','JUN','JUL','AGO','SET','OUT','NOV','DEZ'][month(date)] || '/'
  ELSE '/' || strftime(date, '%m') || '/' END || strftime(date, '%Y') || ' TRANSACAO ' || {BR_ABS} || ' ' || CASE WHEN neg THEN 'D' ELSE 'C' END || ' ' ||
  translate(format('{{:,.2f}}', (row_id * 100 + 7) / 100.0), ',.', '.,') AS own FROM mov)
SELECT file, page_no, date, cents, CASE WHEN row_id % 3 <> 0 THEN memo ELSE own END AS memo FROM t""")
def x7(spark, sf):
    return rows_out(V.extract_smart(smart_words(spark, sf), 2000))


@query("x9_smart_balances", f"""{MOVES} SELECT file, page_no, CAST(100000 AS BIGINT) AS bal_start, max(row_id) * 100 + 7 AS bal_end FROM mov GROUP BY 1, 2""")
def x9(spark, sf):
    return balance_cents(V.smart_balances(smart_words(spark, sf), 2000), "file", "page_no")


def balance_cents(df: DataFrame, *keys) -> DataFrame:
    return df.select(*keys, to_cents("bal_start").alias("bal_start"), to_cents("bal_end").alias("bal_end"))


def g331_lines(spark, sf):
    bal = F.when(c("row_id") % 3 == 0, T(fmt_brl(from_cents(c("row_id") * 100 + 7)), "C"))
    body = [T(F.when(c("row_id") % 5 == 0, F.lit("10:15")), date_br(), "3935 99020", c("memo"), c("mag_txt"), c("dc"), bal), rest_line()]
    return to_lines(movements(spark, sf), body, [F.lit("G331 EXTRATO"), F.lit("Saldo Anterior 500,00 D")], [F.lit("S A L D O 1.150,00 C"), F.lit("fim da folha")])


@query("x10_bb_g331", f"""{MOVES} SELECT file, page_no, date, cents, CASE WHEN row_id % 5 = 0 THEN '10:15 ' ELSE '' END || {REST_SQL} AS memo,
  CASE WHEN row_id % 3 = 0 THEN row_id * 100 + 7 END AS balance FROM mov""")
def x10(spark, sf):
    return rows_out(X.extract_bb_g331(g331_lines(spark, sf)), to_cents("balance").alias("balance"))


# the closing line stands below the last slot of a page; a shorter page ends with its last balance
@query("x10_bb_g331_balances", f"""{MOVES} SELECT file, page_no, CAST(CASE WHEN min(slot) = 0 THEN -50000 END AS BIGINT) AS bal_start,
  CAST(CASE WHEN max(slot) = 39 THEN 115000 ELSE max(row_id) FILTER (WHERE row_id % 3 = 0) * 100 + 7 END AS BIGINT) AS bal_end FROM mov GROUP BY 1, 2""")
def x10b(spark, sf):
    return balance_cents(X.bb_g331_balances(g331_lines(spark, sf)), "file", "page_no")


def bb_dot_lines(spark, sf):
    bal = F.when(c("row_id") % 3 == 0, T(fmt_brl(from_cents(c("row_id") * 100 + 7)), "D"))
    body = [T(date_br("dd.MM.yyyy"), c("memo"), c("mag_txt"), c("dc"), bal), rest_line()]
    return to_lines(movements(spark, sf), body, [F.lit("Conta Corrente"), F.lit("30.04.2025 Saldo anterior 0,00 C")], [F.lit("Mod. 0.51.291-3")])


@query("x11_bb_dot", f"{MOVES} SELECT file, page_no, date, cents, {REST_SQL} AS memo, CASE WHEN row_id % 3 = 0 THEN -(row_id * 100 + 7) END AS balance FROM mov")
def x11(spark, sf):
    return rows_out(X.extract_bb_dot(bb_dot_lines(spark, sf)), to_cents("balance").alias("balance"))


@query("a1_file_balances", f"""{MOVES} SELECT file, CAST(0 AS BIGINT) AS bal_start, -(max(row_id) FILTER (WHERE row_id % 3 = 0) * 100 + 7) AS bal_end FROM mov GROUP BY 1""")
def a1(spark, sf):
    return balance_cents(file_balances(X.bb_dot_balances(bb_dot_lines(spark, sf))), "file")


@query("x12_bb_full", f"""{MOVES}, d AS (SELECT *, CASE WHEN row_id % 5 = 0 THEN
    coalesce(lag(right(strftime(date, '%Y'), 1)) OVER (PARTITION BY file, page_no ORDER BY slot), '0') ELSE right(strftime(date, '%Y'), 1) END AS digit FROM mov),
  f AS (SELECT *, TRY_CAST(left(strftime(date, '%Y'), 3) || digit || strftime(date, '-%m-%d') AS DATE) AS rd FROM d)
SELECT file, page_no, rd AS date, cents, memo FROM f WHERE rd IS NOT NULL""")
def x12(spark, sf):
    full = T(date_br(), "3935 99020870", c("memo"), c("mag_txt"), c("dc"))
    short = T(F.left(date_br(), F.lit(9)), "9903", c("memo"), F.concat(c("mag_txt"), F.when(c("neg"), " (-)").otherwise(" (+)")))
    lines = to_lines(movements(spark, sf), [F.when(c("row_id") % 5 == 0, short).otherwise(full)], [F.lit("DATA LANÇAMENTO 01/01/2025 3935 99020870 X 1,00 C")])
    return rows_out(X.extract_bb_full(lines, 2000))


@query("x13_bb_simple", f"""{MOVES} SELECT file, page_no, date, cents, CASE row_id % 4 WHEN 0 THEN memo || ' 1234 5678' WHEN 1 THEN memo || ' 9903'
  WHEN 2 THEN memo || ' ' || {BR_ABS} || CASE WHEN neg THEN ' (-)' ELSE ' (+)' END ELSE memo END AS memo FROM mov""")
def x13(spark, sf):
    amount = F.concat(c("mag_txt"), F.when(c("neg"), " (-)").otherwise(" (+)"))
    form = c("row_id") % 4
    body = [F.when(form == 0, date_br()).when(form == 1, T(date_br(), c("memo"))).when(form == 2, T(date_br(), c("memo"), amount))
            .otherwise(T(date_br(), "9903", c("memo"), amount)),
            F.when(form == 0, F.lit(" ")), F.when(form == 0, c("memo")), F.when(form == 0, T("1234 5678", amount)).when(form == 1, T("9903", amount))]
    return rows_out(X.extract_bb_simple(to_lines(movements(spark, sf), body, [F.lit("01/01/2025 SALDO ANTERIOR 5,00 (+)")]), 2000))


def cef_lines(spark, sf):
    return to_lines(movements(spark, sf), [T(date_br(), "000123", c("memo"), c("mag_txt"), c("dc"), fmt_brl(from_cents(c("row_id") * 100 + 7)), "D")],
                    [F.lit("Extrato por período"), F.lit("000000 SALDO ANTERIOR 0,00 1.395,46 C")])


@query("x14_cef", f"{MOVES} SELECT file, page_no, date, cents, memo, '000123' AS doc_id, -(row_id * 100 + 7) AS balance FROM mov")
def x14(spark, sf):
    return rows_out(X.extract_cef(cef_lines(spark, sf)), "doc_id", to_cents("balance").alias("balance"))


@query("x14_cef_balances", f"{MOVES} SELECT file, page_no, CAST(139546 AS BIGINT) AS bal_start, -(max(row_id) * 100 + 7) AS bal_end FROM mov GROUP BY 1, 2")
def x14b(spark, sf):
    return balance_cents(X.cef_balances(cef_lines(spark, sf)), "file", "page_no")


def santander_lines(spark, sf):
    sign = F.when(c("neg"), "-").otherwise("+")
    day = F.when(c("slot") % 10 == 5, T(date_br(), "Saldo do dia Cc + ContaMax principal R$", fmt_brl(from_cents(c("row_id") * 100 + 7))))
    return to_lines(movements(spark, sf), [T(date_br(), c("memo"), sign, "R$", c("mag_txt")), day], [F.lit("Internet Banking")])


@query("x15_santander", ROWS)
def x15(spark, sf):
    return rows_out(X.extract_santander(santander_lines(spark, sf)))


@query("x15_santander_balances", f"""{MOVES} SELECT file, page_no, min(row_id) FILTER (WHERE slot % 10 = 5) * 100 + 7 AS bal_start,
  max(row_id) FILTER (WHERE slot % 10 = 5) * 100 + 7 AS bal_end FROM mov GROUP BY 1, 2""")
def x15b(spark, sf):
    return balance_cents(X.santander_balances(santander_lines(spark, sf)), "file", "page_no")


def sicredi_lines(spark, sf):
    value = F.concat(F.when(c("neg"), "-").otherwise(""), c("mag_txt"))
    return to_lines(movements(spark, sf), [T(date_br(), c("memo"), value, fmt_brl(from_cents(c("row_id") * 100 + 7)))],
                    [F.lit("Associado: X Cooperativa: Y"), F.lit("SALDO ANTERIOR 33.971,01")])


@query("x16_sicredi", ROWS)
def x16(spark, sf):
    return rows_out(X.extract_sicredi(sicredi_lines(spark, sf)))


@query("x16_sicredi_balances", f"{MOVES} SELECT file, page_no, CAST(3397101 AS BIGINT) AS bal_start, max(row_id) * 100 + 7 AS bal_end FROM mov GROUP BY 1, 2")
def x16b(spark, sf):
    return balance_cents(X.sicredi_balances(sicredi_lines(spark, sf)), "file", "page_no")


def stone_lines(spark, sf):
    kind = F.when(c("neg"), "Saída").otherwise("Entrada")
    fee = c("row_id") % 9 == 0
    core = T(date_br(), kind, F.when(fee, F.lit("Tarifa")).when(c("row_id") % 2 == 0, F.lit("Recebível")), c("mag_txt"),
             fmt_brl(from_cents(c("row_id") * 100 + 7)))
    above = F.when(~fee, c("memo"))
    return to_lines(movements(spark, sf), [above, core, F.when(~fee, F.lit("Pix | Maquininha")), F.when(~fee, F.lit("Loja 1"))], [F.lit("DATA TIPO LANÇAMENTO VALOR")])


@query("x17_stone", f"""{MOVES} SELECT file, page_no, date, cents, CASE WHEN row_id % 9 = 0 THEN 'Tarifa' ELSE memo || ' ' ||
  CASE WHEN row_id % 2 = 0 THEN 'Recebível' WHEN neg THEN 'Saída' ELSE 'Entrada' END || ' Pix | Maquininha Loja 1' END AS memo,
  row_id * 100 + 7 AS balance FROM mov""")
def x17(spark, sf):
    return rows_out(X.extract_stone(stone_lines(spark, sf), 2025), to_cents("balance").alias("balance"))


def plain_words(spark, sf):
    return to_words(movements(spark, sf), [(30, date_br(), 0), (100, c("memo"), 0), (480, F.concat(F.when(c("neg"), "-").otherwise(""), c("mag_txt")), 0),
                                           (520, fmt_brl(from_cents(c("row_id") * 100 + 7)), 0)])


LINE_TEXT = f"strftime(date, '%d/%m/%Y') || ' ' || memo || ' ' || CASE WHEN neg THEN '-' ELSE '' END || {BR_ABS} || ' ' || translate(format('{{:,.2f}}', (row_id * 100 + 7) / 100.0), ',.', '.,')"


@query("x18_words_to_lines", f"{MOVES} SELECT file, page_no, CAST(100 + slot * 48 AS INTEGER) AS line_no, {LINE_TEXT} AS text FROM mov")
def x18(spark, sf):
    return V.words_to_lines(plain_words(spark, sf)).select("file", "page_no", "line_no", "text")


@query("x19_slice_columns", f"""{MOVES} SELECT file, page_no, CAST(100 + slot * 48 AS INTEGER) AS line_no, strftime(date, '%d/%m/%Y') AS col_date, memo AS col_memo,
  CASE WHEN neg THEN '-' ELSE '' END || {BR_ABS} AS col_value FROM mov""")
def x19(spark, sf):
    spec = {"col_date": (0, 95), "col_memo": (95, 330), "col_value": (450, 518)}
    return V.slice_columns(V.words_to_lines(plain_words(spark, sf)), spec).select("file", "page_no", "line_no", *spec)


@query("x20_itau", f"{MOVES} SELECT file, page_no, date, cents, memo, row_id * 100 + 7 AS balance FROM mov")
def x20(spark, sf):
    return rows_out(V.extract_itau(plain_words(spark, sf)), to_cents("balance").alias("balance"))


def n_in_file():
    return c("row_id") % 1000


def bradesco_words(spark, sf):
    mov = movements(spark, sf)
    dated = F.when(n_in_file() % 7 == 0, date_br())
    head = F.when((c("slot") == 0), F.lit("Extrato de: Entre 01/01/1900 e 31/12/2099"))
    foot = F.when(c("slot") == 39, F.lit("Total"))
    return to_words(mov, [(100, head, 0), (30, dated, 1), (100, c("memo"), 1), (350, F.when(~c("neg"), c("mag_txt")), 1), (450, F.when(c("neg"), c("mag_txt")), 1),
                          (520, fmt_brl(from_cents(c("row_id") * 100 + 7)), 1), (100, rest_line(), 2),
                          (100, foot, 3), (520, F.when(c("slot") == 39, F.lit("999,99")), 3)])


CARRIED = "last_value(CASE WHEN row_id % 1000 % 7 = 0 THEN date END IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("x21_bradesco", f"{MOVES} SELECT file, page_no, {CARRIED} AS date, cents, {REST_SQL} AS memo, row_id * 100 + 7 AS balance FROM mov")
def x21(spark, sf):
    return rows_out(V.extract_bradesco(bradesco_words(spark, sf)), to_cents("balance").alias("balance"))


@query("x21_bradesco_balances", f"""{MOVES} SELECT file, page_no, CAST(NULL AS BIGINT) AS bal_start, CAST(CASE WHEN max(slot) = 39 THEN 99999 ELSE max(row_id) * 100 + 7 END AS BIGINT) AS bal_end
  FROM mov GROUP BY 1, 2""")
def x21b(spark, sf):
    return balance_cents(V.bradesco_balances(bradesco_words(spark, sf)), "file", "page_no")


def sicoob_words(spark, sf):
    mov = movements(spark, sf)
    bal = F.concat(fmt_brl(from_cents(c("row_id") * 100 + 7)), F.lit("D"))
    return to_words(mov, [(100, F.when(c("slot") == 0, F.lit("SALDO ANTERIOR 1.000,00C")), 0), (30, F.when(n_in_file() % 7 == 0, date_br()), 1), (100, c("memo"), 1),
                          (450, F.concat(c("mag_txt"), c("dc")), 1), (530, F.when(c("row_id") % 3 == 0, bal), 1), (100, rest_line(), 2),
                          (100, F.when(c("slot") == 39, F.lit("SALDO DO DIA 77,00D")), 3)])


@query("x22_sicoob", f"""{MOVES} SELECT file, page_no, {CARRIED} AS date, cents, {REST_SQL} AS memo, CASE WHEN row_id % 3 = 0 THEN -(row_id * 100 + 7) END AS balance FROM mov""")
def x22(spark, sf):
    return rows_out(V.extract_sicoob(sicoob_words(spark, sf)), to_cents("balance").alias("balance"))


@query("x22_sicoob_balances", f"""{MOVES} SELECT file, page_no, CAST(CASE WHEN min(slot) = 0 THEN 100000 END AS BIGINT) AS bal_start,
  CAST(CASE WHEN max(slot) = 39 THEN -7700 WHEN min(slot) = 0 THEN 100000 END AS BIGINT) AS bal_end FROM mov GROUP BY 1, 2""")
def x22b(spark, sf):
    return balance_cents(V.sicoob_balances(sicoob_words(spark, sf)), "file", "page_no")


@query("x23_simple", f"""{MOVES}, d AS (SELECT *, CASE WHEN row_id % 5 = 0 THEN TRY_CAST('2025' || strftime(date, '-%m-%d') AS DATE) ELSE date END AS rd FROM mov)
SELECT file, page_no, rd AS date, cents, memo FROM d""")
def x23(spark, sf):
    day = F.when(c("row_id") % 5 == 0, date_br("dd/MM")).otherwise(date_br())
    value = F.when(c("row_id") % 2 == 0, T(c("mag_txt"), c("dc"))).otherwise(F.concat(F.when(c("neg"), "-").otherwise(""), c("mag_txt")))
    return rows_out(X.extract_simple(to_lines(movements(spark, sf), [T(day, c("memo"), value)], [F.lit("EXTRATO")]), 2025))


@query("a2_scan_balances", f"""{MOVES} SELECT file, CAST(CASE WHEN min(slot) = 0 THEN 100000 END AS BIGINT) AS bal_start, CAST(CASE WHEN max(slot) = 39 THEN 115000 END AS BIGINT) AS bal_end
  FROM mov GROUP BY 1""")
def a2(spark, sf):
    return balance_cents(X.scan_balances(dot_lines(spark, sf), DOT_LAYOUT), "file")


# ---- layouts -------------------------------------------------------------------------------------

def pages_text(spark, sf) -> DataFrame:
    """One first page per customer whose wording depends on segment and nation, plus the documents as unknown pages."""
    cust = table(spark, sf, "customer")
    heads = ["Relatório SICOOB", "coop cred central", "Total Disponivel em conta", "INTERNET BANKING", "EXTRATO POR PERIODO", "conta stone",
             "ASSOCIADO: X COOPERATIVA: Y", "AGENCIA 1 LOTE 2", "Agência e Lancamentos do Periodo", "lançamentos do período", "sem marca"]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (c("c_custkey") % len(heads) + 1).cast("int"))
    known = cust.select(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("file"), F.lit(1).alias("page_no"),
                        F.concat_ws("\n", head, c("c_name"), c("c_mktsegment")).alias("text"))
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), c("doc_id").cast("string")).alias("file"), F.lit(1).alias("page_no"), "text")
    return dealt(known.unionByName(docs), cust.count() + docs.count(), "file")


PAGES = """WITH pages_t AS (SELECT 'c' || c_custkey AS file, ['Relatório SICOOB','coop cred central','Total Disponivel em conta','INTERNET BANKING','EXTRATO POR PERIODO','conta stone',
  'ASSOCIADO: X COOPERATIVA: Y','AGENCIA 1 LOTE 2','Agência e Lancamentos do Periodo','lançamentos do período','sem marca'][c_custkey % 11 + 1] || chr(10) || c_name || chr(10) || c_mktsegment AS text FROM customer
  UNION ALL SELECT 'd' || doc_id, text FROM documents), n AS (SELECT file, text, strip_accents(upper(text)) AS u FROM pages_t)"""


def _case(field: str) -> str:
    import unicodedata
    plain = lambda k: "".join(x for x in unicodedata.normalize("NFD", k.upper()) if unicodedata.category(x) != "Mn")
    arms = []
    for lay in shipped_layouts():
        test = " AND ".join(f"contains(u, '{plain(k)}')" for k in lay["keywords"])
        arms.append(f"WHEN {test} THEN '{lay[field]}'")
    return "CASE " + " ".join(arms) + " END"


DETECTED = f"{PAGES}, det AS (SELECT file, text, {_case('name')} AS layout, {_case('bank_id')} AS bank_id FROM n)"


@query("l1_detect_layout", f"{DETECTED} SELECT file, layout, bank_id FROM det")
def l1(spark, sf):
    return detect_layout(pages_text(spark, sf), shipped_layouts()).select("file", "layout", "bank_id")


def _exact_arms() -> str:
    arms = []
    for lay in shipped_layouts():
        test = " AND ".join(f"contains(text, '{k}')" for k in lay["keywords"])
        arms.append(f"SELECT file, '{lay['name']}' AS layout FROM n WHERE {test}")
    return " UNION ".join(arms)


@query("l2_identify", f"{PAGES} {_exact_arms()}")
def l2(spark, sf):
    return identify(pages_text(spark, sf), shipped_layouts())


LAYOUT_TABLE = f"""{PAGES}, lays AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS priority, 'L' || c_custkey AS name, CAST(c_custkey % 7 AS VARCHAR) AS bank_id, [upper(c_name), c_mktsegment, 'sem'] AS ks FROM customer
  UNION ALL SELECT 'x' || lpad(CAST(doc_id AS VARCHAR), 9, '0'), 'D' || doc_id, 'd', [substr(text, 3, 40), substr(text, 1, 6)] FROM documents WHERE length(text) > 60)"""


def layout_table(spark, sf) -> DataFrame:
    """A layout for each customer and document: names, a segment that many share, beginnings of texts."""
    cust, docs = table(spark, sf, "customer"), table(spark, sf, "documents").where("length(text) > 60")
    return cust.select(F.lpad(c("c_custkey").cast("string"), 9, "0").alias("priority"), F.concat(F.lit("L"), "c_custkey").alias("name"), (c("c_custkey") % 7).cast("string").alias("bank_id"),
                       F.array(F.upper("c_name"), "c_mktsegment", F.lit("sem")).alias("keywords")).unionByName(
        docs.select(F.concat(F.lit("x"), F.lpad(c("doc_id").cast("string"), 9, "0")).alias("priority"), F.concat(F.lit("D"), "doc_id").alias("name"), F.lit("d").alias("bank_id"),
                    F.array(F.substring("text", 3, 40), F.substring("text", 1, 6)).alias("keywords")))


@query("l1_layout_table", f"""{LAYOUT_TABLE} SELECT file, min_by(name, priority) AS layout, min_by(bank_id, priority) AS bank_id
FROM n LEFT JOIN (SELECT priority, name, bank_id, list_transform(ks, lambda k: strip_accents(upper(k))) AS ks FROM lays) ON contains(u, ks[1]) AND contains(u, ks[2]) AND (len(ks) < 3 OR contains(u, ks[3])) GROUP BY file""")
def l1b(spark, sf):
    return detect_layout(pages_text(spark, sf), layout_table(spark, sf)).select("file", "layout", "bank_id")


@query("l2_layout_table", f"""{LAYOUT_TABLE} SELECT DISTINCT file, name AS layout FROM n JOIN lays ON contains(text, ks[1]) AND contains(text, ks[2]) AND (len(ks) < 3 OR contains(text, ks[3]))""")
def l2b(spark, sf):
    return identify(pages_text(spark, sf), layout_table(spark, sf))


@query("l3_detection_status", f"""{DETECTED} SELECT file, CASE WHEN layout IS NULL THEN 'Layout not detected in Text mode.' END AS error,
  layout IS NULL AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50 AS low_text FROM det""")
def l3(spark, sf):
    return detect_layout(pages_text(spark, sf), shipped_layouts()).select("file", "error", "low_text")


RULE = "CASE WHEN layout IS NULL THEN NULL ELSE coalesce(CASE bank_id " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in W.RULE_SETS.items()) + " END, CASE upper(replace(layout, ' ', '')) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in W.RULE_SETS.items()) + " END, 'generic') END"


@query("l4_route", f"{DETECTED} SELECT file, {RULE} AS rule_set FROM det")
def l4(spark, sf):
    return route(detect_layout(pages_text(spark, sf), shipped_layouts())).select("file", "rule_set")


BANK_CASE = "CASE bank_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in W.BANKS.items()) + " ELSE 'Banco Desconhecido' END"


@query("l5_bank_name", f"""{DETECTED} SELECT file, {BANK_CASE} AS bank_name,
  CASE WHEN bank_id IS NULL THEN 'Não Detectado' ELSE {BANK_CASE} || ' (' || bank_id || ')' END AS label FROM det""")
def l5(spark, sf):
    return detect_layout(pages_text(spark, sf), shipped_layouts()).select("file", bank_name("bank_id").alias("bank_name"), bank_label("bank_id").alias("label"))


@query("l6_sublayout", f"""{MOVES}, p AS (SELECT file, page_no, min(cust % 4) AS v, min(slot) AS s FROM mov GROUP BY 1, 2)
SELECT file, page_no, CASE v WHEN 0 THEN 'g331' WHEN 1 THEN 'dot' WHEN 2 THEN 'full' ELSE 'simple' END AS sublayout FROM p""")
def l6(spark, sf):
    mov = movements(spark, sf)
    kind = mov.groupBy("file", "page_no").agg(F.min(c("cust") % 4).alias("v"))
    texts = F.array(F.lit("G331 x\n01.01.2025"), F.lit("x\n01.01.2025 y"), F.lit("a\n05/03/2025 3935 99020870 z"), F.lit("02/01/2025 Dep"))
    pages = kind.select("file", "page_no", F.element_at(texts, (c("v") + 1).cast("int")).alias("text"), F.lit("bb").alias("rule_set"))
    return with_sublayout(pages).select("file", "page_no", "sublayout")


# ---- the whole extraction ------------------------------------------------------------------------

def as_pages(lines: DataFrame, prefix: str) -> DataFrame:
    """LINES back to page texts; a page is bounded."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("file", "page_no").agg(texts.alias("text")).withColumn("file", F.concat(F.lit(prefix + "-"), c("file")))


def itau_words(spark, sf):
    mov = movements(spark, sf)
    head = to_words(mov, [(100, F.when(c("slot") == 0, F.lit("Lançamentos do período Saldo total")), 0)])
    body = to_words(mov, [(30, date_br(), 1), (100, c("memo"), 1), (480, F.concat(F.when(c("neg"), "-").otherwise(""), c("mag_txt")), 1),
                          (520, fmt_brl(from_cents(c("row_id") * 100 + 7)), 1)])
    return head.unionByName(body).withColumn("file", F.concat(F.lit("itau-"), c("file")))


def mixed_statements(spark, sf):
    """The same movements printed in five layouts, and the documents as pages no layout knows."""
    bb = bb_dot_lines(spark, sf)
    bb = bb.withColumn("text", F.when(c("text") == "Conta Corrente", "Agência Dia Histórico Lote").otherwise(c("text")))
    own = dot_lines(spark, sf)
    own = own.withColumn("text", F.when(c("text") == "EXTRATO DE CONTA", "EXTRATO DE CONTA PROPRIA").otherwise(c("text")))
    words = itau_words(spark, sf)
    parts = [as_pages(cef_lines(spark, sf), "cef"), as_pages(santander_lines(spark, sf), "santander"), as_pages(sicredi_lines(spark, sf), "sicredi"),
             as_pages(stone_lines(spark, sf).withColumn("text", F.when(c("text").startswith("DATA TIPO"), "Stone DATA TIPO LANÇAMENTO").otherwise(c("text"))), "stone"),
             as_pages(bb, "bb"), as_pages(own, "own"), as_pages(V.words_to_lines(words), "x").withColumn("file", F.substring("file", 3, 1000)),
             table(spark, sf, "documents").select(F.concat(F.lit("doc-"), c("doc_id").cast("string")).alias("file"), F.lit(1).alias("page_no"), "text")]
    pages = parts[0]
    for p in parts[1:]:
        pages = pages.unionByName(p)
    own_layout = {**DOT_LAYOUT, "name": "Own", "keywords": ["conta propria"], "priority": "99_own"}
    return pages, words, [*shipped_layouts(), own_layout]


MIXED = f"""{MOVES} SELECT 'cef-' || file AS file, date, cents, memo FROM mov UNION ALL SELECT 'santander-' || file, date, cents, memo FROM mov
UNION ALL SELECT 'sicredi-' || file, date, cents, memo FROM mov UNION ALL SELECT 'itau-' || file, date, cents, memo FROM mov
UNION ALL SELECT 'bb-' || file, date, cents, {REST_SQL} FROM mov UNION ALL SELECT 'own-' || file, date, cents, {REST_SQL} FROM mov
UNION ALL SELECT 'stone-' || file, date, cents, memo || ' ' || CASE WHEN row_id % 2 = 0 THEN 'Recebível' WHEN neg THEN 'Saída' ELSE 'Entrada' END || ' Pix | Maquininha Loja 1' FROM mov WHERE row_id % 9 <> 0"""


@query("x_extract_statements", MIXED)
def whole_extraction(spark, sf):
    return extract_statements(*mixed_statements(spark, sf), 2000).txn.select("file", "date", to_cents("amount").alias("cents"), "memo")


@query("x_extract_status", f"""WITH t AS (SELECT file, count(*) AS tx_count FROM ({MIXED}) GROUP BY 1)
SELECT file, CASE split_part(file, '-', 1) WHEN 'cef' THEN 'CEF' WHEN 'santander' THEN 'Santander' WHEN 'sicredi' THEN 'Sicredi Associado' WHEN 'itau' THEN 'Itau' WHEN 'bb' THEN 'Banco do Brasil'
  WHEN 'own' THEN 'Own' ELSE 'Stone' END AS layout, 'Text' AS method, tx_count, CAST(NULL AS VARCHAR) AS error FROM t
UNION ALL SELECT 'doc-' || doc_id, lay, CASE WHEN lay IS NULL THEN 'unknown' ELSE 'Failed' END, 0, CASE WHEN lay IS NULL THEN 'Layout not detected in Text mode.' END
  FROM (SELECT doc_id, {_case('name')} AS lay FROM (SELECT doc_id, strip_accents(upper(text)) AS u FROM documents))""")
def whole_status(spark, sf):
    return extract_statements(*mixed_statements(spark, sf), 2000).status.select("file", "layout", "method", "tx_count", "error")
