"""OFX statement files, read record by record so that large files split."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.scalars import once, or_null, parse_date, rx, strip
from tallybook.schemas import MONEY
from tallybook.sources.texts import cp1252, read_records


def _tag(name: str) -> Column:
    """Value of a tag, closed or not."""
    return or_null(strip(rx("value", rf"<{name}>([^<\r\n]*)")))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """One record per transaction block; the text before the first block comes as its own record."""
    return once(read_records(spark, path, "<STMTTRN>"), ["file", "pos"], cp1252(F.col("value")).alias("value"))


def read_ofx(spark: SparkSession, path: str) -> DataFrame:
    """Posted transactions; blocks without a readable date or amount are left out."""
    rows = _records(spark, path).filter(F.col("value").contains("<DTPOSTED>"))
    rows = rows.withColumn("value", F.substring_index("value", "</STMTTRN>", 1))
    rows = once(rows, ["file", "pos", "value"], parse_date(F.left(_tag("DTPOSTED"), F.lit(8)), "yyyyMMdd").alias("date"),
                F.replace(_tag("TRNAMT"), F.lit(","), F.lit(".")).try_cast(MONEY).alias("amount")).filter("date is not null and amount is not null")
    return rows.select(
        "file", F.col("pos").alias("internal_id"), "date", "amount",
        F.coalesce(_tag("MEMO"), F.lit("")).alias("description"), _tag("FITID").alias("fitid"), _tag("CHECKNUM").alias("doc_id"),
        F.lit("Bank").alias("source"))


def ofx_accounts(spark: SparkSession, path: str) -> DataFrame:
    """(file, bank, agency, account) from the part before the first transaction."""
    head = _records(spark, path).filter(F.col("value").contains("ACCTFROM>"))
    return head.select("file", F.coalesce(_tag("ORG"), F.lit("")).alias("bank"), _tag("BANKID").alias("agency"), _tag("ACCTID").alias("account"))


def file_period(txn: DataFrame) -> DataFrame:
    """S7."""
    return txn.groupBy("file").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
