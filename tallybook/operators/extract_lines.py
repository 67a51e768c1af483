"""Statement rules on LINES(file, page_no, line_no, text): any number of files in one job.

Each rule classifies lines, extracts fields with regular expressions and joins continuation lines by a
running count of start lines, per page where the rule's state ends with the page.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions import words as W
from tallybook.functions.scalars import (amount_with_seps, br_amount_abs, fitid, g, groups, has, has_word, is_continuation, once,
                                         or_null, parse_date, rx, signed, strip, to_layout_date)
from tallybook.operators.ordering import joined_text, previous, running_count
from tallybook.schemas import MONEY

PAGE = ["file", "page_no"]
PLACE = [*PAGE, "line_no"]


def _no_money() -> Column:
    return F.lit(None).cast(MONEY)


def _page_order():
    return Window.partitionBy(*PAGE).orderBy("line_no")


def _page_group(start: Column) -> Column:
    """Number of start lines so far on the page."""
    return F.sum(start.cast("int")).over(_page_order().rowsBetween(Window.unboundedPreceding, 0))


def _txn(df: DataFrame, **extra: Column) -> DataFrame:
    cols = {"doc_id": F.lit(None).cast("string"), "balance": _no_money(), **extra}
    return df.select(*PLACE, "date", F.col("amount").cast(MONEY).alias("amount"), "memo",
                     *[c.alias(n) for n, c in cols.items()])


def _joined(df: DataFrame, group: list[str], start: Column, piece: Column, fields: list[str]) -> DataFrame:
    """One row per group that has a start line: its fields, and the pieces of all its lines in order as memo."""
    heads = [F.max(F.when(start, F.col(c))).alias(c) for c in fields]
    return (df.groupBy(*group).agg(F.max(start).alias("__has"), *heads,
                                   joined_text(piece, ["page_no", "line_no"]).alias("memo"))
            .filter("__has").drop("__has"))


def _first_last(df: DataFrame, start: Column | None, end: Column | None, group: list[str] = PAGE) -> DataFrame:
    """Opening = first non-null ``start``, closing = last non-null ``end`` in reading order."""
    order = F.struct("page_no", "line_no")
    none = F.lit(None).cast(MONEY)
    pick = [(F.min_by if f == "bal_start" else F.max_by)(c, F.when(c.isNotNull(), order)).cast(MONEY).alias(f)
            if c is not None else none.alias(f) for f, c in (("bal_start", start), ("bal_end", end))]
    return df.groupBy(*group).agg(*pick)


def _dc(text: Column, pattern: str, value: int, mark: int) -> Column:
    """Amount with a C / D mark; null where the pattern does not match."""
    return F.when(has(text, pattern), _marked(rx(text, pattern, value), rx(text, pattern, mark)))


def _marked(value: Column, mark: Column, negative: str = "D") -> Column:
    return signed(br_amount_abs(value), mark == negative)


def _matched(lines: DataFrame, pattern: str, n: int, text: Column | None = None, keep: Column | None = None) -> DataFrame:
    """Lines on which the pattern occurs, with its groups as ``g``."""
    text = F.col("text") if text is None else text
    rows = lines if keep is None else lines.filter(keep)
    return once(rows, PLACE, groups(text, pattern, n).alias("g")).filter("g is not null")


# ---- X1-X6: layout-driven ------------------------------------------------------------------------

def map_fields(lines: DataFrame, layout: dict) -> DataFrame:
    """Capture groups -> date, memo, amount, type, doc_id with the sign rules; adds ``is_match``."""
    pattern = "^(?:" + layout["line_pattern"] + ")"
    thousands = layout.get("amount_thousand_separator", ".")
    decimal = layout.get("amount_decimal_separator", ",")
    number_of = {c["name"]: c["match_group"] for c in layout["columns"] if c.get("match_group")}
    lines = once(lines, lines.columns, groups("text", pattern, max(number_of.values(), default=1)).alias("g"))
    group = {name: or_null(g(i)) for name, i in number_of.items()}
    null = F.lit(None).cast("string")

    def number(name: str) -> Column:
        return amount_with_seps(group[name], thousands, decimal) if name in group else _no_money()

    amount = number("amount")
    mark = F.translate(F.upper(strip(group.get("type", null))), "()", "")
    amount = (F.when(mark.isin(W.DEBIT_MARKS), -F.abs(amount)).when(mark.isin(W.CREDIT_MARKS), F.abs(amount))
              .otherwise(amount))
    debit, credit = number("amount_debit"), number("amount_credit")
    if "amount_debit" in group:
        has_debit = strip(group["amount_debit"]).isNotNull()
        amount = (F.when(has_debit & (debit > 0), -debit).when(has_debit, amount)
                  .when(credit > 0, credit).otherwise(amount))
    elif "amount_credit" in group:
        amount = F.when(credit > 0, credit).otherwise(amount)
    date = to_layout_date(group["date"], layout.get("date_format", "%d/%m/%Y")) if "date" in group else F.lit(None).cast("date")
    rows = once(lines, [c for c in lines.columns if c != "g"], F.col("g").isNotNull().alias("is_match"), date.alias("date"),
                F.coalesce(amount, F.lit(0)).cast(MONEY).alias("amount"),
                F.coalesce(strip(group.get("memo", null)), F.lit("")).alias("memo"), strip(group.get("doc_id", null)).alias("doc_id"))
    return (rows.withColumn("type", F.when(F.col("amount") < 0, "DEBIT").otherwise("CREDIT"))
            .withColumn("fitid", fitid(F.col("date"), F.col("amount"))))


def split_discarded(mapped: DataFrame, cleanup: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows put aside for recovery); zero amounts are in neither."""
    real = F.col("is_match") & (F.col("amount") != 0)
    blocked = has(F.lower("memo"), "|".join(W.BALANCE_MEMO_BLOCK)) if cleanup else F.lit(False)
    return mapped.filter(real & ~blocked), mapped.filter(real & blocked)


GENERIC = [*PLACE, "date", "amount", "memo", "type", "fitid", "doc_id"]


def extract_generic(lines: DataFrame, layout: dict) -> tuple[DataFrame, DataFrame]:
    """Transactions with their continuation lines, and the discarded candidates.

    A memo runs on over page ends, so the running count spans the file, page block by page block.
    """
    mapped = map_fields(lines, layout)
    cleanup = layout.get("has_balance_cleanup", True)
    blocked = has(F.lower("memo"), "|".join(W.BALANCE_MEMO_BLOCK)) if cleanup else F.lit(False)
    start = F.col("is_match") & (F.col("amount") != 0) & ~blocked
    more = ~F.col("is_match") & is_continuation("text")
    rows = mapped.filter(start | more).withColumn("is_start", start)
    rows = running_count(rows, ["file"], "page_no", ["line_no"], F.col("is_start"), "grp").filter("grp > 0")
    fields = ["page_no", "line_no", "date", "amount", "type", "fitid", "doc_id"]
    heads = F.col("is_start")
    piece = F.when(heads, F.col("memo")).otherwise(strip("text"))
    names = {c: f"h_{c}" for c in fields}
    rows = rows.select("*", *[F.col(c).alias(h) for c, h in names.items()])
    out = _joined(rows, ["file", "grp"], heads, piece, list(names.values()))
    out = out.select("file", *[F.col(h).alias(c) for c, h in names.items()], "memo").select(*GENERIC)
    return out, split_discarded(mapped, cleanup)[1].select(*GENERIC)


def extract_memo_above(lines: DataFrame, layout: dict) -> DataFrame:
    """The memo is the line above, unless that is a transaction or a header."""
    text = lines.withColumn("text", strip("text")).filter("text <> ''")
    rows = previous(map_fields(text, layout), ["file"], "page_no", ["line_no"],
                    {"above": F.col("text"), "above_match": F.col("is_match")})
    usable = ~F.col("above_match") & ~has_word("above", [w.upper() for w in W.HEADER_ABOVE])
    return (rows.filter(F.col("is_match") & (F.col("amount") != 0))
            .withColumn("memo", F.when(usable, F.col("above")).otherwise(F.lit(W.NO_DESCRIPTION))).select(*GENERIC))


def scan_balances(lines: DataFrame, layout: dict) -> DataFrame:
    """A2: first start balance and last end balance of the file; group 2 of the layout's patterns."""
    def value(name: str) -> Column | None:
        pattern = layout.get(name)
        if not pattern:
            return None
        found = "(?iu)" + pattern
        return F.when(has("text", found), amount_with_seps(
            rx("text", found, 2), layout.get("amount_thousand_separator", "."), layout.get("amount_decimal_separator", ",")))
    return _first_last(lines, value("balance_start_pattern"), value("balance_end_pattern"), ["file"])


# ---- X10-X13: code 001 ---------------------------------------------------------------------------

# fixed values: line patterns
G331 = r"(\d{2}/\d{2}/\d{4})\s+(?:\d{2}/\d{2}/\d{4}\s+)?(\d+)\s+(\d+)\s+(.*?)\s+([\d\.,]+)\s+([CD])(?:\s+([\d\.,]+)\s+([CD]))?"
DOT_LINE = r"^(\d{2}\.\d{2}\.\d{4})\s+(.*)"
DOT_TAIL = r"([\d\.,]+)\s+([CD])(?:\s+([\d\.,]+)\s+([CD]))?\s*$"
FULL = r"(\d{2}/\d{2}/\d{4})\s+(\d{4})\s+(\d{8})\s+(.*?)\s+([\d\.,]+)\s+([CD])"
COMPACT = r"(\d{2}/\d{2}/\d{3,4})\s+\d+\s+(?:\d+\s+)?(.*?)\s+([\d\.]+,\d{2})\s*\(([+\-])\)"
PLUS_MINUS = r"([\d\.,]+)\s*\(([+\-])\)"


def _before(text: Column, pattern: str) -> Column:
    """Text before the first match."""
    return strip(F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(pattern)) - 1))


def _g331(lines: DataFrame) -> DataFrame:
    rows = once(lines, PLACE, strip("text").alias("text"))
    rows = once(rows, [*PLACE, "text"], groups("text", G331, 8).alias("g"))
    t = F.col("text")
    closing = t.contains("S A L D O") | t.contains("Saldo Atual")
    date = F.when(~closing & ~t.contains("Saldo Anterior"), parse_date(g(1)))
    rows = once(rows, [*PLACE, "text", "g"], date.alias("date"), closing.alias("is_closing"), (
        has(t, r"\d{2}/\d{2}/\d{4}") | has_word(t, W.G331_STOP)).alias("may_stop"))
    txn = F.col("date").isNotNull()
    # a printed balance counts against the account only with a D
    balance = F.when(txn & (g(7) != ""), F.when(g(8) == "D", -br_amount_abs(g(7))).otherwise(br_amount_abs(g(7))))
    return once(rows, [*PLACE, "text", "date", "is_closing"], txn.alias("is_txn"), (~txn & F.col("may_stop")).alias("is_stop"),
                F.when(txn, _marked(g(5), g(6))).alias("amount"), balance.cast(MONEY).alias("balance"),
                F.when(txn, F.concat_ws(" ", or_null(_before(t, G331)), strip(g(4)))).alias("memo"))


def extract_bb_g331(lines: DataFrame) -> DataFrame:
    """X10."""
    rows = _g331(lines).filter("text <> ''").withColumn("grp", _page_group(F.col("is_txn") | F.col("is_stop")))
    rows = rows.filter("grp > 0 and not is_stop").withColumn("at", F.col("line_no"))
    piece = F.coalesce("memo", "text")
    out = _joined(rows, [*PAGE, "grp"], F.col("is_txn"), piece, ["at", "date", "amount", "balance"])
    return _txn(out.withColumnRenamed("at", "line_no"), balance=F.col("balance"))


def bb_g331_balances(lines: DataFrame) -> DataFrame:
    """X10 balances per page."""
    rows = _g331(lines)
    mark = r"([\d\.,]+)\s+([CD])"
    end = F.coalesce(F.col("balance"), F.when(F.col("is_closing"), _dc(F.col("text"), mark, 1, 2)))
    return _first_last(rows, _dc(F.col("text"), r"Saldo Anterior\s+([\d\.,]+)\s+([CD])", 1, 2), end)


def _dot(lines: DataFrame) -> DataFrame:
    rows = once(lines, PLACE, strip("text").alias("text"))
    rows = once(rows, [*PLACE, "text"], groups("text", DOT_LINE, 2).alias("line"))
    rest = g(2, "line")
    rows = once(rows, [*PLACE, "text", "line"], groups(rest, DOT_TAIL, 4).alias("g"), F.col("line").isNotNull().alias("is_dated"),
                F.coalesce(rest.contains("Saldo anterior"), F.lit(False)).alias("is_opening"))
    txn = F.col("g").isNotNull() & ~F.col("is_opening")
    return once(rows, [*PLACE, "text", "is_dated"], txn.alias("is_txn"),
                F.when(F.col("is_opening"), _marked(g(1), g(2))).alias("opening"), F.when(txn, parse_date(g(1, "line"), "dd.MM.yyyy")).alias("date"),
                F.when(txn, _marked(g(1), g(2))).alias("amount"), F.when(txn & (g(3) != ""), _marked(g(3), g(4))).alias("balance"),
                F.when(txn, _before(rest, DOT_TAIL)).alias("memo"))


def extract_bb_dot(lines: DataFrame) -> DataFrame:
    """X11."""
    rows = _dot(lines).filter("text <> ''").withColumn("grp", _page_group(F.col("is_dated"))).filter("grp > 0")
    rows = rows.filter(F.col("is_txn") | (~F.col("is_dated") & ~has_word("text", W.DOT_IGNORED)))
    rows = rows.withColumn("at", F.col("line_no"))
    out = _joined(rows, [*PAGE, "grp"], F.col("is_txn"), F.coalesce("memo", "text"), ["at", "date", "amount", "balance"])
    return _txn(out.withColumnRenamed("at", "line_no"), balance=F.col("balance"))


def bb_dot_balances(lines: DataFrame) -> DataFrame:
    """X11 balances per page: the last opening line wins, the last second amount closes."""
    rows = _dot(lines)
    order = F.col("line_no")
    return rows.groupBy(*PAGE).agg(
        F.max_by("opening", F.when(F.col("opening").isNotNull(), order)).alias("bal_start"),
        F.max_by("balance", F.when(F.col("balance").isNotNull(), order)).alias("bal_end"))


def _compact_year(raw: Column, known_digit: Column, default_year: int) -> Column:
    """A three-digit year is completed with the last digit of the row before."""
    return F.when(F.length(raw) == 9, F.concat(raw, F.coalesce(known_digit, F.lit(str(default_year)[-1])))).otherwise(raw)


def extract_bb_full(lines: DataFrame, default_year: int) -> DataFrame:
    """X12."""
    rows = once(lines, PLACE, strip("text").alias("text")).filter(~has_word("text", W.FULL_HEADER))
    rows = once(rows, PLACE, groups("text", FULL, 6).alias("f"), groups("text", COMPACT, 4).alias("k"))
    rows = rows.filter("f is not null or k is not null")
    full = F.col("f").isNotNull()
    rows = once(rows, PLACE, F.when(full, g(1, "f")).otherwise(g(1, "k")).alias("raw"),
                F.when(full, _marked(g(5, "f"), g(6, "f"))).otherwise(_marked(g(3, "k"), g(4, "k"), "-")).alias("amount"),
                strip(F.when(full, g(4, "f")).otherwise(g(2, "k"))).alias("memo"))
    return _txn(_with_year(rows, default_year, "date").filter("date is not null"))


def _with_year(rows: DataFrame, default_year: int, name: str) -> DataFrame:
    """Date from ``raw``; a three-digit year takes its last digit from the row before."""
    rows = once(rows, rows.columns, F.when((F.length("raw") == 10) & parse_date("raw").isNotNull(), F.substring("raw", 10, 1)).alias("__whole"))
    digit = F.last("__whole", ignorenulls=True).over(_page_order().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__digit", digit)
    return once(rows, [c for c in rows.columns if not c.startswith("__") and c != "raw"],
                parse_date(_compact_year(F.col("raw"), F.col("__digit"), default_year)).alias(name))


def extract_bb_simple(lines: DataFrame, default_year: int) -> DataFrame:
    """Compact rows; a date alone, its amount within the next four lines; date and text, its amount on this
    line or the next. Lines used by a row above are not read again."""
    page = _page_order()
    rows = once(lines, PLACE, strip("text").alias("text"))
    t = F.col("text")
    rows = once(rows, [*PLACE, "text"], groups(t, COMPACT, 4).alias("k"), groups(t, PLUS_MINUS, 2).alias("pm"),
                groups(t, r"^(\d{2}/\d{2}/\d{4})(?:\s+(.*))?", 2).alias("d"), has(t, r"^\d{2}/\d{2}/\d{4}\s*$").alias("alone"))
    rows = _with_year(rows.withColumn("raw", g(1, "k")), default_year, "c_date")
    rows = once(rows, [*PLACE, "text", "k", "c_date", "alone"], F.col("d").isNotNull().alias("is_dated"), parse_date(g(1, "d")).alias("d_date"),
                F.col("pm").isNotNull().alias("has_amt"), _marked(g(1, "pm"), g(2, "pm"), "-").alias("amt"), _before(t, PLUS_MINUS).alias("lead_txt"),
                F.coalesce(g(2, "d"), F.lit("")).alias("rest"))
    usable = F.col("c_date").isNull() & F.col("d_date").isNotNull()
    rows = once(rows, [c for c in rows.columns if c not in ("alone", "d_date")], F.col("c_date").isNotNull().alias("is_c"),
                (usable & F.col("alone")).alias("is_d"), (usable & ~F.col("alone") & (F.col("rest") != "") & ~has_word("rest", W.SIMPLE_HEADER)).alias("is_t"),
                "d_date")
    cell = F.struct("text", "is_dated", "has_amt", "amt", "lead_txt")
    rows = rows.withColumn("ahead", F.collect_list(cell).over(page.rowsBetween(1, 4)))
    # first line ahead that ends the search: a dated line or an amount
    ends = F.transform("ahead", lambda x: (x["text"] != "") & (x["is_dated"] | x["has_amt"]))
    rows = once(rows, rows.columns, F.array_position(ends, F.lit(True)).cast("int").alias("at"))
    hit = F.when(F.col("at") > 0, F.get("ahead", F.col("at") - 1))
    d_ok = F.col("is_d") & (F.col("at") > 0) & ~hit["is_dated"]
    between = F.filter(F.transform(F.slice("ahead", 1, F.greatest(F.col("at") - 1, F.lit(0))), lambda x: x["text"]), lambda x: x != "")
    d_memo = F.concat_ws(" ", F.concat(between, F.filter(F.array(hit["lead_txt"]), lambda x: x != "")))
    nxt = F.get("ahead", F.lit(0))
    t_next = F.col("is_t") & ~F.col("has_amt") & F.coalesce(nxt["has_amt"], F.lit(False))
    rows = rows.select("*", F.coalesce(d_ok, F.lit(False)).alias("d_ok"), hit["amt"].alias("d_amt"), d_memo.alias("d_memo"),
                       t_next.alias("t_next"), nxt["amt"].alias("n_amt"), nxt["lead_txt"].alias("n_txt"))
    # lines taken by a row above: by a date line up to four away, by a text line directly above
    taken = F.coalesce(F.lag("t_next", 1).over(page), F.lit(False))
    for k in range(1, 5):
        taken = taken | F.coalesce(F.lag(F.when(F.col("d_ok"), F.col("at")), k).over(page) >= k, F.lit(False))
    rows = rows.withColumn("taken", taken).filter("not taken")
    t_memo = F.concat_ws(" ", strip("rest"), F.when(F.col("t_next"), or_null(F.col("n_txt"))))
    out = rows.select(
        *PLACE,
        F.when(F.col("is_c"), F.col("c_date")).otherwise(F.col("d_date")).alias("date"),
        F.when(F.col("is_c"), _marked(g(3, "k"), g(4, "k"), "-"))
        .when(F.col("d_ok"), F.col("d_amt")).when(F.col("t_next"), F.col("n_amt"))
        .when(F.col("is_t") & F.col("has_amt"), F.col("amt")).alias("amount"),
        F.when(F.col("is_c"), strip(g(2, "k"))).when(F.col("is_d"), F.col("d_memo")).otherwise(t_memo).alias("memo"),
        (F.col("is_c") | F.col("d_ok") | F.col("is_t")).alias("keep"), "is_c")
    return _txn(out.filter(F.col("keep") & F.col("amount").isNotNull() & (F.col("is_c") | (F.col("memo") != ""))))


# ---- X14-X16, X23: one line, one row -------------------------------------------------------------

CEF = r"(\d{2}/\d{2}/\d{4})\s+(\d+)\s+(.*?)\s+([\d\.,]+)\s+([CD])\s+([\d\.,]+)\s+([CD])"
CEF_OPENING = r"000000\s+SALDO ANTERIOR\s+([\d\.,]+)\s+([\d\.,]+)\s+([CD])"
SANTANDER = r"(\d{2}/\d{2}/\d{4})\s+(.*?)\s+([+-])\s+R\$\s+([\d\.,]+)"
SANTANDER_DAY = r"(\d{2}/\d{2}/\d{4})\s+Saldo do dia\s+(.*?)\s+R\$\s+([\d\.,]+)"
SICREDI = r"(\d{2}/\d{2}/\d{4})\s+(.*?)\s+(-?[\d\.,]+)\s+([\d\.,]+)"
SIMPLE = r"^(\d{2}/\d{2}(?:/\d{4})?)\s+(.+?)\s+(-?[\d\.]+,\d{2})\s?([DC])?$"


def extract_cef(lines: DataFrame) -> DataFrame:
    """X14."""
    rows = _matched(lines, CEF, 7, strip("text"), ~has("text", CEF_OPENING))
    rows = once(rows, PLACE, parse_date(g(1)).alias("date"), _marked(g(4), g(5)).alias("amount"), strip(g(3)).alias("memo"), g(2).alias("doc"),
                _marked(g(6), g(7)).alias("bal"))
    return _txn(rows.filter("date is not null"), doc_id=F.col("doc"), balance=F.col("bal"))


def cef_balances(lines: DataFrame) -> DataFrame:
    """X14 balances per page."""
    t = strip("text")
    return _first_last(lines, _dc(t, CEF_OPENING, 2, 3), F.when(~has(t, CEF_OPENING), _dc(t, CEF, 6, 7)))


def extract_santander(lines: DataFrame) -> DataFrame:
    """X15."""
    rows = _matched(lines, SANTANDER, 4, strip("text"), ~has("text", SANTANDER_DAY))
    rows = once(rows, PLACE, parse_date(g(1)).alias("date"), strip(g(2)).alias("memo"), _marked(g(4), g(3), "-").alias("amount"))
    return _txn(rows.filter("date is not null"))


def santander_balances(lines: DataFrame) -> DataFrame:
    """X15 balances per page: first and last day balance."""
    t = strip("text")
    day = F.when(has(t, SANTANDER_DAY), br_amount_abs(rx(t, SANTANDER_DAY, 3)))
    return _first_last(lines, day, day)


def extract_sicredi(lines: DataFrame) -> DataFrame:
    """X16. The row balance closes the page but is not part of the row."""
    rows = _matched(lines, SICREDI, 4)
    rows = once(rows, PLACE, parse_date(g(1)).alias("date"), strip(g(2)).alias("memo"), signed(br_amount_abs(g(3)), g(3).contains("-")).alias("amount"))
    return _txn(rows.filter("date is not null"))


def sicredi_balances(lines: DataFrame) -> DataFrame:
    """X16 balances per page."""
    t = F.col("text")
    opening = r"SALDO ANTERIOR\s+([\d\.,]+)"
    row = has(t, SICREDI) & parse_date(rx(t, SICREDI)).isNotNull()
    return _first_last(lines, F.when(has(t, opening), br_amount_abs(rx(t, opening))),
                       F.when(row, br_amount_abs(rx(t, SICREDI, 4))))


def extract_simple(lines: DataFrame, default_year: int) -> DataFrame:
    """X23."""
    raw, value, mark = g(1), g(3), g(4)
    date = parse_date(F.when(F.length(raw) <= 5, F.concat(raw, F.lit(f"/{default_year}"))).otherwise(raw))
    rows = _matched(lines, SIMPLE, 4)
    return _txn(rows.select(*PLACE, date.alias("date"), strip(g(2)).alias("memo"),
                            signed(br_amount_abs(value), (mark == "D") | ((mark == "") & value.startswith("-"))).alias("amount")))


# ---- X17: blocks around an anchor ----------------------------------------------------------------

# fixed values: line patterns and lines left out
STONE_FULL = r"(?iuU)^(\d{2}/\d{2}(?:/\d{2,4})?)\s+(E\w+|S\w+|Cr.dito|D.bito)\s+(.*?)\s+(-?\s*(?:R\$\s*)?[\d\.]+,\d{2})\s+(-?\s*(?:R\$\s*)?[\d\.]+,\d{2})"
STONE_SHORT = r"(?iuU)^(\d{2}/\d{2}(?:/\d{2,4})?)\s+(E\w+|S\w+|Cr.dito|D.bito)\s+(-?\s*(?:R\$\s*)?[\d\.]+,\d{2})\s+(-?\s*(?:R\$\s*)?[\d\.]+,\d{2})"
STONE_STOP = ["DATA TIPO LANÇAMENTO", "SALDO", "TRANSPORTE"]


def extract_stone(lines: DataFrame, default_year: int) -> DataFrame:
    """Between two anchors the upper one takes up to two lines below it, then the lower one up to three above."""
    rows = once(lines, PLACE, strip("text").alias("text")).filter("text <> ''")
    t = F.col("text")
    rows = once(rows, [*PLACE, "text"], has(t, r"^(\d{2}/\d{2}(?:/\d{2,4})?)(\s|$)").alias("is_anchor"), groups(t, STONE_FULL, 5).alias("f"),
                groups(t, STONE_SHORT, 4).alias("k"), has(t, r"\d{2,},\d{2}").alias("money"), has_word(t, STONE_STOP).alias("header"))
    full = F.col("f").isNotNull()
    raw, kind = F.when(full, g(1, "f")).otherwise(g(1, "k")), F.when(full, g(2, "f")).otherwise(g(2, "k"))
    desc, value = F.when(full, g(3, "f")).otherwise(""), F.when(full, g(4, "f")).otherwise(g(3, "k"))
    bal = F.when(full, g(5, "f")).otherwise(g(4, "k"))
    parsed = F.col("is_anchor") & raw.isNotNull()
    fee = F.lower(desc).contains("tarifa") | F.lower(kind).contains("tarifa")
    date = F.coalesce(parse_date(F.when(F.length(raw) == 10, raw)), parse_date(F.when(F.length(raw) == 8, raw), "dd/MM/yy"),
                      parse_date(F.when(F.length(raw) == 5, F.concat(raw, F.lit(f"/{default_year}")))))
    rows = once(rows, [*PLACE, "text", "is_anchor"], F.coalesce(parsed & ~fee, F.lit(False)).alias("takes"), parsed.alias("is_txn"), date.alias("date"),
                signed(br_amount_abs(value), F.upper(kind).isin(W.STONE_OUT)).alias("amount"), br_amount_abs(bal).alias("balance"),
                F.when(strip(desc) != "", strip(desc)).otherwise(strip(kind)).alias("core"), F.col("money").cast("int").alias("money"),
                (F.col("money") | F.col("header")).cast("int").alias("stop"))
    # what a line needs to know stands at most two lines above and three below: one sort of a page is enough
    cell = F.struct("is_anchor", "takes", "money", "stop")
    rows = rows.select("*", _page_group(F.col("is_anchor")).alias("gap"), *[F.lag(cell, k).over(_page_order()).alias(f"up{k}") for k in (1, 2)],
                       *[F.lead(cell, k).over(_page_order()).alias(f"down{k}") for k in (1, 2, 3)])
    up1, up2, down1, down2, down3 = map(F.col, ("up1", "up2", "down1", "down2", "down3"))
    free = ~F.col("is_anchor")
    upper = F.when(up1["is_anchor"], up1["takes"]).otherwise((up1["money"] == 0) & up2["is_anchor"] & up2["takes"])
    lower = F.when(down2["is_anchor"], down2["takes"]).otherwise((down2["stop"] == 0) & down3["is_anchor"] & down3["takes"])
    lower = F.when(down1["is_anchor"], down1["takes"]).otherwise((down1["stop"] == 0) & lower)
    goes_up = free & (F.col("money") == 0) & F.coalesce(upper, F.lit(False))
    goes_down = free & (F.col("stop") == 0) & F.coalesce(lower, F.lit(False))
    core = F.col("is_txn") & F.col("date").isNotNull()
    rows = rows.withColumn("gap", F.when(core | goes_up, F.col("gap")).when(goes_down, F.col("gap") + 1)).filter("gap is not null")
    rows = rows.withColumn("is_core", core).withColumn("at", F.col("line_no"))
    out = _joined(rows, [*PAGE, "gap"], F.col("is_core"), F.when(F.col("is_core"), F.col("core")).otherwise(F.col("text")), ["at", "date", "amount", "balance"])
    return _txn(out.withColumnRenamed("at", "line_no"), balance=F.col("balance"))


def row_balances(txn: DataFrame) -> DataFrame:
    """Page balances taken from the rows: first and last."""
    return _first_last(txn, F.col("balance"), F.col("balance"))
