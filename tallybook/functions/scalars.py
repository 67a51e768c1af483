"""Column functions: amounts, dates, texts, predicates. All JVM expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import words as W
from tallybook.schemas import MONEY


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: What Unicode calls white space.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def rx(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(col(c), pattern, group)


def has(c: Column | str, pattern: str) -> Column:
    return col(c).rlike(pattern)


GROUP_MARK = "\x01"


def groups(c: Column | str, pattern: str, n: int) -> Column:
    """All n groups of the first match in one pass, null without a match; a group that took no part is ''."""
    marks = GROUP_MARK.join(f"${i}" for i in range(1, n + 1))
    return F.when(has(c, pattern), F.split(F.regexp_replace(col(c), f"(?s)^.*?(?:{pattern}).*$", marks), GROUP_MARK))


def g(i: int, name: str = "g") -> Column:
    """Group i (from 1) of a ``groups`` column."""
    return F.get(F.col(name), F.lit(i - 1))


def once(df: DataFrame, keep: list[str], *cols: Column) -> DataFrame:
    """Select whose columns are computed one time.

    A plain select is merged into every later filter and projection that uses it, and a regular expression or a
    number parse would then run once per use; the one-row generator keeps it in place.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*cols))))


def any_of(words: list[str]) -> str:
    """Regex alternation of literal words."""
    return "|".join(re.escape(w) for w in words)


def has_word(c: Column | str, words: list[str]) -> Column:
    """Upper-cased text contains one of the (upper-case) words."""
    # most places of a text are ruled out by their letter, before any word is tried
    first = re.escape("".join(sorted({w[0] for w in words})))
    return F.upper(col(c)).rlike(f"(?=[{first}])(?:{any_of(words)})")


def or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def to_cents(c: Column | str) -> Column:
    return F.round(col(c) * 100, 0).cast("bigint")


def from_cents(c: Column | str) -> Column:
    return (col(c).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast(MONEY)


# ---- amounts -------------------------------------------------------------------------------------

def _br_number(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(MONEY)


def br_amount_abs(c: Column | str) -> Column:
    """F1: ``1.234,56`` -> 1234.56, always positive; unreadable -> 0."""
    return F.coalesce(F.abs(_br_number(col(c))), F.lit(0).cast(MONEY))


def br_amount_signed(c: Column | str) -> Column:
    """keeps a minus sign."""
    return F.coalesce(_br_number(col(c)), F.lit(0).cast(MONEY))


def br_amount_suffix(c: Column | str) -> Column:
    """amount with a C / D / * suffix. A leading minus acts twice (``-5,00`` -> 5.00)."""
    def read(txt: Column) -> Column:
        value = _br_number(F.regexp_replace(txt, r"[^\d,.\-]", ""))
        negative = txt.endswith("D") | txt.contains("-")
        return F.coalesce(F.when(negative, -value).otherwise(value), F.lit(0)).cast(MONEY)
    # the lambda's argument is computed once
    return F.get(F.transform(F.array(F.upper(strip(c))), read), F.lit(0))


def amount_with_seps(c: Column | str, thousands: str, decimal: str) -> Column:
    """amount with the layout's separators; unreadable -> null."""
    txt = F.replace(col(c), F.lit(thousands), F.lit("")) if thousands else col(c)
    return F.replace(txt, F.lit(decimal), F.lit(".")).try_cast(MONEY)


def signed(amount: Column, negative: Column) -> Column:
    return F.when(negative, -F.abs(amount)).otherwise(F.abs(amount)).cast(MONEY)


def sign_by_keywords(amount: Column, text: Column, negative: list[str], positive: list[str]) -> Column:
    """debit words win, then credit words, else the amount as it is."""
    return (F.when(has_word(text, negative), -F.abs(amount))
            .when(has_word(text, positive), F.abs(amount)).otherwise(amount)).cast(MONEY)


# ---- dates ---------------------------------------------------------------------------------------

# fixed values: strftime marks and their Spark letters
STRFTIME = {"%d": "dd", "%m": "MM", "%Y": "yyyy", "%y": "yy"}


def spark_format(strftime: str) -> str:
    out = strftime
    for mark, letters in STRFTIME.items():
        out = out.replace(mark, letters)
    return out


def parse_date(c: Column | str, fmt: str = "dd/MM/yyyy") -> Column:
    return F.try_to_timestamp(col(c), F.lit(fmt)).cast("date")


def to_layout_date(c: Column | str, strftime: str) -> Column:
    """F5."""
    return parse_date(c, spark_format(strftime))


def flex_date(day: Column, month: Column, year: Column, default_year: Column) -> Column:
    """month as number or Portuguese name, year of 0, 2 or 4 digits; impossible dates -> null."""
    names = F.create_map(*[F.lit(x) for i, m in enumerate(W.MONTHS, 1) for x in (m, i)])
    mon = F.coalesce(names[F.upper(month)], month.try_cast("int"))
    yr = (F.when(F.length(year) == 2, F.lit(2000) + year.try_cast("int"))
          .when(F.length(year) == 4, year.try_cast("int")).otherwise(default_year.cast("int")))
    # a cast gives null where there is no such day; a parser would throw, and try an older parser, for each text
    text = F.concat(F.lpad(yr.cast("string"), 4, "0"), F.lit("-"), mon.cast("string"), F.lit("-"), day.try_cast("int").cast("string"))
    return F.when(yr.between(1, 9999), text.try_cast("date"))


def fmt_date_br(c: Column | str) -> Column:
    """a date as dd/MM/yyyy."""
    return F.date_format(col(c), "dd/MM/yyyy")


def iso_text_to_br(c: Column | str) -> Column:
    """F11 on text: ISO dates reformatted, anything else kept."""
    return F.coalesce(F.date_format(parse_date(c, "yyyy-MM-dd"), "dd/MM/yyyy"), col(c))


# ---- texts ---------------------------------------------------------------------------------------

def contains_ci_ai(text: Column | str, keyword: Column | str) -> Column:
    """F8: containment ignoring case and accents."""
    return F.contains(F.collate(col(text), "UNICODE_CI_AI"), F.collate(col(keyword), "UNICODE_CI_AI"))


def clean_desc(c: Column | str) -> Column:
    """F9."""
    return F.upper(F.trim(F.regexp_replace(col(c), r"(?U)\s+", " ")))


def fmt_brl(c: Column | str) -> Column:
    """1234.56 -> ``1.234,56``."""
    return F.translate(F.format_number(col(c), 2), ",.", ".,")


def ellipsis(c: Column | str, n: int = 55) -> Column:
    """F12."""
    return F.when(F.length(col(c)) > n, F.concat(F.left(col(c), F.lit(n)), F.lit("..."))).otherwise(col(c))


def surrogate_id(date: Column, amount: Column, memo: Column) -> Column:
    """md5 of timestamp, amount and memo; the amount is written without trailing zeros (``150.0``)."""
    shown = F.regexp_replace(amount.cast(MONEY).cast("string"), r"(\.\d)0$", "$1")
    return F.md5(F.concat(F.date_format(date, "yyyyMMddHHmmss"), shown, F.coalesce(memo, F.lit(""))))


def detail(c: Column | str, name: str) -> Column:
    """one activity detail, from a map column or JSON text."""
    return F.get_json_object(col(c), f"$.{name}")


def fitid(date: Column, amount: Column) -> Column:
    """Yyyymmdd followed by the amount in cents."""
    return F.concat(F.date_format(date, "yyyyMMdd"), F.abs(to_cents(amount)).cast("string"))


# ---- line predicates -----------------------------------------------------------------------------

def is_continuation(c: Column | str) -> Column:
    """May the line extend the memo of the transaction above?"""
    txt = strip(c)
    return ((F.length(txt) >= 3) & ~has(txt, "====|-----|_____") & ~has_word(txt, W.CONTINUATION_BLOCK)
            & ~txt.contains("**/**/****") & ~txt.startswith("..."))


def should_ignore(c: Column | str) -> Column:
    """Empty, balance or total wording, or a stand-alone zero amount."""
    return (col(c) == "") | has_word(c, W.IGNORED_LINE) | has(c, "|".join(W.ZERO_AMOUNTS))
