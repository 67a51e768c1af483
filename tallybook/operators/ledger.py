"""Ledger sign rules from debit and credit accounts."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.scalars import parse_date
from tallybook.schemas import MONEY

# fixed values: codes that are no account
NO_ACCOUNT = ["", "0", "nan"]


def type_ledger(raw: DataFrame) -> DataFrame:
    """Real dates (others dropped), decimal amounts (others 0)."""
    return (raw.withColumn("date", parse_date("date")).filter("date is not null")
            .withColumn("amount", F.coalesce(F.trim("amount").try_cast(MONEY), F.lit(0).cast(MONEY))))


def clean_ledger_amount(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """S3: if any value of the file has a comma, dots are thousands in all of them."""
    txt = F.replace(F.col(col), F.lit(" "), F.lit(""))
    # one flag per file, pre-aggregated, instead of a window over the file
    flag = df.groupBy(*keys).agg(F.max(txt.contains(",")).alias("__comma"))
    plain = F.replace(F.replace(txt, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return (df.join(flag, keys).withColumn(col, F.when(F.col("__comma"), plain).otherwise(txt).try_cast(MONEY))
            .drop("__comma"))


def _sides(raw: DataFrame, keys: list[str]) -> DataFrame:
    return (raw.select(*keys, F.explode(F.array("debit_account", "credit_account")).alias("account"))
            .filter(F.col("account").isNotNull() & ~F.col("account").isin(NO_ACCOUNT)))


def infer_bank_account(raw: DataFrame, keys: list[str]) -> DataFrame:
    """The code used most on either side; the smallest on ties. Counted map-side, then one row per code."""
    n = _sides(raw, keys).groupBy(*keys, "account").agg(F.count("*").alias("n"))
    top = n.groupBy(*keys).agg(F.max("n").alias("n"))
    return n.join(top, [*keys, "n"]).groupBy(*keys).agg(F.min("account").alias("bank_account"))


def apply_ledger_sign(raw: DataFrame, accounts: DataFrame, keys: list[str]) -> DataFrame:
    """Bank account on the debit side +, on the credit side -, on neither unchanged."""
    magnitude = F.abs("amount")
    amount = (F.when(F.col("debit_account") == F.col("bank_account"), magnitude)
              .when(F.col("credit_account") == F.col("bank_account"), -magnitude).otherwise(F.col("amount")))
    return raw.join(accounts, keys, "left").withColumn("amount", amount.cast(MONEY)).drop("bank_account")


def account_profile(raw: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """A10: the most used codes with their debit and credit counts and negative rows."""
    both = (raw.select(*keys, F.col("debit_account").alias("account"), F.lit(1).alias("d"), F.lit(0).alias("c"), "amount")
            .unionByName(raw.select(*keys, F.col("credit_account").alias("account"), F.lit(0).alias("d"), F.lit(1).alias("c"), "amount")))
    counts = both.groupBy(*keys, "account").agg(
        F.count("*").alias("uses"), F.sum("d").alias("debits"), F.sum("c").alias("credits"),
        F.count_if(F.col("amount") < 0).alias("negatives"))
    w = Window.partitionBy(*keys).orderBy(F.desc("uses"), "account")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def sample_rows(raw: DataFrame, accounts: DataFrame, keys: list[str], side: str = "credit", n: int = 5) -> DataFrame:
    """A10: the first rows with the bank account on one side."""
    w = Window.partitionBy(*keys).orderBy("pos")
    hit = raw.join(accounts, keys).filter(F.col(f"{side}_account") == F.col("bank_account")).drop("bank_account")
    return hit.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def to_ledger(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Typed, signed ledger rows with source 'Ledger'."""
    typed = type_ledger(raw)
    return apply_ledger_sign(typed, infer_bank_account(typed, keys), keys).withColumn("source", F.lit("Ledger"))
