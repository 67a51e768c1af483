"""Row cleaning, predicates, projections, deduplication and set operations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions import words as W
from tallybook.functions.scalars import strip
from tallybook.operators.ordering import ordinal
from tallybook.schemas import MONEY
from tallybook.session import PACKED, stored
from tallybook.sinks.commits import add_batch


def to_recon_rows(txn: DataFrame) -> DataFrame:
    """Memo -> description, source 'Bank', plain date."""
    return txn.withColumnRenamed("memo", "description").withColumn("source", F.lit("Bank")).withColumn(
        "date", F.col("date").cast("date"))


def ensure_columns(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Missing columns (name -> type) added as null."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in cols.items() if c not in df.columns])


def drop_zero(df: DataFrame) -> DataFrame:
    """P3."""
    return df.filter(F.abs("amount") > 0.009)


def clip_to_period(bank: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Bank rows between the first and last ledger date of their account, edges included.

    The period table is one row per account, pre-aggregated; AQE broadcasts it only when it is small, and
    splits a hot account's bank rows when it is not.
    """
    period = ledger.groupBy(*keys).agg(F.min("date").alias("__lo"), F.max("date").alias("__hi"))
    return bank.join(period, keys).filter(F.col("date").between(F.col("__lo"), F.col("__hi"))).select(*bank.columns)


def drop_fees(df: DataFrame, text: str = "description") -> DataFrame:
    """P5."""
    return df.filter(~F.lower(text).contains("tarifa"))


def filter_view(view: DataFrame, statuses: list[str], term: str = "") -> DataFrame:
    """One of the statuses ('Conciliado' also as a part), and the term in the description or the amount text."""
    status = F.lit(False)
    for s in statuses:
        status = status | (F.col("status").contains(s) if s == W.MATCHED else F.col("status") == s)
    out = view.filter(status)
    if term:
        low = term.lower()
        # amounts are searched as shown: no trailing zeros
        shown = F.regexp_replace(F.regexp_replace(F.col("amount").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        out = out.filter(F.lower("description").contains(low) | shown.contains(low))
    return out


def filter_entries(df: DataFrame, term: str) -> DataFrame:
    """P7."""
    return df.filter(F.lower("description").contains(term.lower()))


def filter_company(df: DataFrame, term: str, name: str = "name", tax_id: str = "tax_id") -> DataFrame:
    """P8."""
    return df.filter(F.lower(name).contains(term.lower()) | F.col(tax_id).contains(term.lower())) if term else df


def find_amount(df: DataFrame, x: float) -> DataFrame:
    """Rows whose absolute amount is x."""
    return df.filter(F.abs(F.abs("amount") - F.lit(str(x)).cast(MONEY)) < F.lit("0.01").cast(MONEY))


def find_on_day(df: DataFrame, day: str, term: str = "") -> DataFrame:
    """Rows of one day, optionally with a term in the description."""
    out = df.filter(F.col("date") == F.lit(day).cast("date"))
    return out.filter(F.lower("description").contains(term.lower())) if term else out


def normalise_transactions(df: DataFrame) -> DataFrame:
    """P10: date and amount coerced from text; unreadable amounts -> 0."""
    return (df.withColumn("date", F.col("date").try_cast("date"))
            .withColumn("amount", F.coalesce(F.col("amount").try_cast(MONEY), F.lit(0).cast(MONEY))))


def flip_statement(txn: DataFrame, balances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Newest-first statement -> oldest-first, with its true opening and closing balance.

    The statement's last balance stands after its oldest row, so that row is taken off again.
    """
    size = txn.groupBy("file").agg(F.max("internal_id").alias("__max"),
                                   F.max_by("amount", "internal_id").alias("__oldest"))
    flipped = (txn.join(size.select("file", "__max"), "file")
               .withColumn("internal_id", F.col("__max") - F.col("internal_id")).drop("__max"))
    fixed = balances.join(size, "file").select(
        "file", (F.col("bal_end") - F.col("__oldest")).cast(MONEY).alias("bal_start"), F.col("bal_start").alias("bal_end"))
    return flipped, fixed


def flatten_audit(audit: DataFrame) -> DataFrame:
    """Audit rows with a transactions array -> one row per transaction."""
    return audit.select("file", F.inline("transactions"))


def dedup_statement(txn: DataFrame, require_balance: bool = False) -> DataFrame:
    """First row per (file, date, amount, balance, trimmed memo); then internal_id 0.. in reading order."""
    place = ["page_no", "line_no"]
    txn = txn.withColumn("memo", strip("memo"))
    key = ["file", "date", "amount", "balance", "memo"]
    rest = [c for c in txn.columns if c not in [*key, *place]]
    # one row of a key goes on, of several in one place the smallest
    first = txn.groupBy(*key).agg(F.min(F.struct(*place, *rest)).alias("__r")).select(*key, "__r.*").select(*txn.columns)
    if require_balance:
        first = first.filter("balance is not null").unionByName(txn.filter("balance is null"))
    out = ordinal(stored(first, PACKED), ["file"], ["page_no"], ["line_no", "date", "amount", "memo"], "internal_id", written=True)
    return out.withColumn("internal_id", F.col("internal_id") - 1)


def consolidate(dfs: list[DataFrame], key: str = "id") -> DataFrame:
    """Union by name, description never null, one row per (source_file, internal_id) or per content.

    The first of the list counts; of several in one input the smallest row. Rows without an internal_id are rows of their own.
    Sort on write: orderBy('date', 'source_file', 'internal_id').
    """
    out = dfs[0].withColumn("__input", F.lit(0))
    for i, df in enumerate(dfs[1:], 1):
        out = out.unionByName(df.withColumn("__input", F.lit(i)), allowMissingColumns=True)
    out = (out.withColumn("date", F.col("date").cast("date")).withColumn("amount", F.col("amount").cast(MONEY))
           .withColumn("description", strip(F.coalesce("description", F.lit("")))))
    cols = ["source_file", "internal_id"] if key == "id" else ["date", "amount", "description"]
    first = ["__input", *(c for c in ("batch", "source_file", "internal_id") if c in out.columns)]
    rest = [c for c in out.columns if c not in cols]
    order = F.struct(*first, *[c for c in rest if c not in first])
    whole = out.filter("internal_id is not null") if key == "id" else out
    # min_by keeps one row per key map-side, so many copies of one row cost one shuffled row per task
    whole = whole.groupBy(*cols).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*cols, "__r.*").select(*out.columns)
    return (whole.unionByName(out.filter("internal_id is null")) if key == "id" else whole).drop("__input")


def append_batch(df: DataFrame, path: str, batch_id: str) -> bool:
    """D3: add a batch to the accumulated table; no deduplication between batches. A batch that the table has already is left out (false)."""
    return add_batch(df, path, batch_id)


def duplicates(df: DataFrame, cols: list[str]) -> DataFrame:
    """Every member of a group of equal rows, with the group's size."""
    sizes = df.groupBy(*cols).agg(F.count("*").alias("copies")).filter("copies > 1")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]
    return df.alias("a").join(sizes.alias("b"), on).select("a.*", "b.copies")


def extraction_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(date, amount) only in a or only in b."""
    lhs, rhs = (x.select("date", F.round("amount", 2).cast(MONEY).alias("amount")) for x in (a, b))
    return (lhs.subtract(rhs).withColumn("only_in", F.lit("a"))
            .unionByName(rhs.subtract(lhs).withColumn("only_in", F.lit("b"))))


def all_entries(bank_only: DataFrame, manual: DataFrame) -> DataFrame:
    """D6."""
    return bank_only.unionByName(manual, allowMissingColumns=True)


def grep_context(lines: DataFrame, pattern: Column | str, k: int) -> DataFrame:
    """Lines that match, with k lines before and after on their page."""
    hit = F.col("text").rlike(pattern) if isinstance(pattern, str) else pattern
    w = Window.partitionBy("file", "page_no").orderBy("line_no")
    marked = lines.withColumn("is_match", hit)
    near = F.max("is_match").over(w.rowsBetween(-k, k))
    return marked.withColumn("__near", near).filter("__near").drop("__near")
