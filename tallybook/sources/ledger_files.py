"""Accounting ledger files: the exported CSV and the running-balance text."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.scalars import br_amount_abs, has, or_null, parse_date, rx, strip
from tallybook.operators.ordering import carry_last, joined_text, previous, running_count
from tallybook.schemas import MONEY
from tallybook.sources.texts import head_lines, latin1, read_records

# fixed values: field numbers of the export
FIELDS = {"transaction_id": 0, "key": 1, "date": 2, "debit_account": 3, "credit_account": 7, "amount": 11, "description": 15}
PREAMBLE, MIN_FIELDS = 5, 12
DEFAULT_COMPANY = "Empresa"


def _records(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path).withColumn("value", latin1(F.col("value")))


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """LEDGER_RAW rows; the five preamble lines and lines with fewer than twelve fields are left out."""
    rows = _records(spark, path)
    last_preamble = (head_lines(rows.select("file", "pos"), PREAMBLE).groupBy("file").agg(F.max("pos").alias("__from")))
    # one short row per file; large files keep their splits
    body = rows.join(last_preamble, "file").filter(F.col("pos") > F.col("__from"))
    fields = F.split(strip("value"), ";")
    return (body.withColumn("f", fields).filter(F.size("f") >= MIN_FIELDS)
            .select("file", "pos", *[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(n) for n, i in FIELDS.items()]))


def read_plain_ledger_csv(spark: SparkSession, path: str, columns: str, structured: DataFrame | None = None) -> DataFrame:
    """S1 fallback: comma CSV with a header, for the files that have no line of the export's shape."""
    rows = (spark.read.option("header", "true").option("recursiveFileLookup", "true").schema(columns).csv(path)
            .select("*", F.col("_metadata.file_path").alias("file")))
    if structured is not None:
        rows = rows.join(structured.select("file").distinct(), "file", "left_anti")
    date = F.coalesce(F.col("date").try_cast("date"), parse_date("date"))
    return (rows.withColumn("date", date)
            .withColumn("amount", F.coalesce(F.col("amount").try_cast(MONEY), F.lit(0).cast(MONEY))))


def ledger_company(spark: SparkSession, path: str) -> DataFrame:
    """(file, company) from the title line."""
    second = head_lines(_records(spark, path), 2).filter("idx = 1").withColumn("t", strip("value"))
    parts = F.split("t", " - ", 2)
    name, head = strip(F.get(parts, F.lit(1))), F.get(parts, F.lit(0))
    code = or_null(strip(F.get(F.split(head, "empresa"), F.size(F.split(head, "empresa")) - 1)))
    title = F.lower("t").contains("empresa") & (F.size(parts) > 1)
    company = (F.when(title & F.lower(head).contains("empresa") & code.isNotNull(), F.concat(code, F.lit(" - "), name))
               .when(title, name).otherwise(DEFAULT_COMPANY))
    return second.select("file", company.alias("company"))


# ---- S5 ------------------------------------------------------------------------------------------

DATE_LINE = r"^(\d{2}/\d{2}/\d{4})$"
BALANCE_LINE = r"^([\d\.]+,\d{2})([DC])"
# fixed values: lines without content
SKIPPED = "Total|Saldo anterior|TRANSPORTE"


def ledger_from_balance_lines(lines: DataFrame) -> DataFrame:
    """Entries from running balances. ``amount`` is the absolute change, ``signed_amount`` keeps its direction.

    Date, previous balance and memo run over the whole file; they are carried from page to page.
    """
    order = ["line_no"]
    rows = lines.withColumn("text", strip("text")).filter(~has("text", SKIPPED))
    rows = carry_last(rows, ["file"], "page_no", order, {"date": F.when(has("text", DATE_LINE), parse_date(rx("text", DATE_LINE)))})
    rows = rows.filter(~has("text", DATE_LINE))
    entry = has("text", BALANCE_LINE)
    value = br_amount_abs(rx("text", BALANCE_LINE))
    rows = rows.withColumn("is_entry", entry).withColumn("balance", F.when(entry, F.when(
        rx("text", BALANCE_LINE, 2) == "D", value).otherwise(-value)))
    entries = previous(rows.filter("is_entry"), ["file"], "page_no", order, {"before": F.col("balance")})
    change = (F.col("balance") - F.coalesce("before", F.lit(0))).cast(MONEY)
    amounts = entries.select("file", "page_no", "line_no", change.alias("change"))
    rows = running_count(rows, ["file"], "page_no", order, F.col("is_entry"), "grp").filter("grp > 0")
    piece = F.when(F.col("is_entry"), strip(F.regexp_replace("text", BALANCE_LINE, ""))).otherwise(F.col("text"))
    heads = F.col("is_entry")
    out = rows.groupBy("file", "grp").agg(
        *[F.max(F.when(heads, F.col(c))).alias(c) for c in ("page_no", "line_no", "date")],
        joined_text(piece, ["page_no", "line_no"]).alias("description"))
    return out.join(amounts, ["file", "page_no", "line_no"]).select(
        "file", "page_no", "line_no", "date", F.abs("change").cast(MONEY).alias("amount"), F.col("change").alias("signed_amount"),
        "description", F.lit("Ledger").alias("source"))
