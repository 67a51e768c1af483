"""Balances: scan, check, repair, audits. TXN rows carry file, page_no, line_no, amount, type."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions import words as W
from tallybook.functions.scalars import clean_desc, strip
from tallybook.schemas import MONEY



def _place() -> Column:
    return F.struct("page_no", "line_no")


def file_balances(pages: DataFrame) -> DataFrame:
    """A1: opening of the first page that has one, closing of the last."""
    return pages.groupBy("file").agg(
        F.min_by("bal_start", F.when(F.col("bal_start").isNotNull(), F.col("page_no"))).alias("bal_start"),
        F.max_by("bal_end", F.when(F.col("bal_end").isNotNull(), F.col("page_no"))).alias("bal_end"))


def _sums(txn: DataFrame, balances: DataFrame) -> DataFrame:
    """One row per file: balances and the movement, pre-aggregated before the join."""
    total = txn.groupBy("file").agg(F.sum("amount").cast(MONEY).alias("total"), F.count("*").alias("tx_count"))
    return balances.join(total, "file", "left").withColumn("total", F.coalesce("total", F.lit(0)).cast(MONEY))


def validate_balance(txn: DataFrame, balances: DataFrame) -> DataFrame:
    """A3: opening + movement against closing; null where a balance is missing."""
    calc = (F.col("bal_start") + F.col("total")).cast(MONEY)
    diff = F.abs(calc - F.col("bal_end")).cast(MONEY)
    known = F.col("bal_start").isNotNull() & F.col("bal_end").isNotNull()
    two = lambda c: c.cast(MONEY).cast("string")
    message = F.concat(F.lit("❌ Divergência: Calc: "), two(calc), F.lit(" | Real: "), two(F.col("bal_end")),
                       F.lit(" | Diff: "), two(diff))
    return _sums(txn, balances).select(
        "file", "bal_start", "bal_end", F.when(known, diff < 0.02).alias("is_valid"),
        F.when(~known, W.MSG_UNKNOWN).when(diff < 0.02, W.MSG_VALID).otherwise(message).alias("msg"),
        F.when(known, diff).alias("diff"))


def _gaps(txn: DataFrame, balances: DataFrame) -> DataFrame:
    gap = (F.col("bal_end") - F.col("bal_start") - F.col("total")).cast(MONEY)
    return _sums(txn, balances).select("file", gap.alias("gap")).filter("gap is not null")


def _first_hit(rows: DataFrame, gaps: DataFrame, hit: Column) -> DataFrame:
    """First row per file, in reading order, that explains the gap. Kept map-side as one row per file."""
    return (rows.join(gaps, "file").filter(hit).groupBy("file").agg(F.min(_place()).alias("__at"))
            .select("file", "__at.page_no", "__at.line_no"))


def _flip(txn: DataFrame, at: DataFrame) -> DataFrame:
    marked = txn.join(at.withColumn("__flip", F.lit(True)), ["file", "page_no", "line_no"], "left")
    amount = F.when(F.col("__flip"), -F.col("amount")).otherwise(F.col("amount")).cast(MONEY)
    kind = F.when(F.col("__flip"), F.when(amount < 0, "DEBIT").otherwise("CREDIT")).otherwise(F.col("type"))
    return marked.withColumn("type", kind).withColumn("amount", amount).select(*txn.columns)


def repair_sign_flip(txn: DataFrame, balances: DataFrame) -> DataFrame:
    """A4: the first row whose opposite sign closes the gap is turned."""
    return _flip(txn, _first_hit(txn, _gaps(txn, balances), F.abs(F.col("gap") + 2 * F.col("amount")) < 0.02))


def repair_ghost(txn: DataFrame, discarded: DataFrame, balances: DataFrame) -> DataFrame:
    """A5: the first discarded row that closes the gap comes back."""
    at = _first_hit(discarded, _gaps(txn, balances), F.abs(F.col("gap") - F.col("amount")) < 0.02)
    return txn.unionByName(discarded.join(at, ["file", "page_no", "line_no"], "left_semi").select(*txn.columns))


def auto_repair(txn: DataFrame, discarded: DataFrame, balances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that do not add up get a sign flip, else a restored row. Returns rows and one status row per file."""
    checked = validate_balance(txn, balances)
    broken = checked.filter("is_valid = false and diff > 0.001").select("file")
    gaps = _gaps(txn, balances).join(broken, "file", "left_semi")
    flips = _first_hit(txn, gaps, F.abs(F.col("gap") + 2 * F.col("amount")) < 0.02)
    ghosts = _first_hit(discarded, gaps.join(flips, "file", "left_anti"), F.abs(F.col("gap") - F.col("amount")) < 0.02)
    fixed = _flip(txn, flips).unionByName(
        discarded.join(ghosts, ["file", "page_no", "line_no"], "left_semi").select(*txn.columns))
    fixes = flips.select("file", F.lit(W.MSG_FLIPPED).alias("fix")).unionByName(ghosts.select("file", F.lit(W.MSG_RESTORED).alias("fix")))
    counts = txn.groupBy("file").agg(F.count("*").alias("tx_count"))
    done = F.col("fix").isNotNull()
    status = checked.join(fixes, "file", "left").join(counts, "file", "left").select(
        "file", F.when(done, True).otherwise(F.col("is_valid")).alias("is_valid"), F.coalesce("fix", "msg").alias("msg"),
        F.when(F.col("tx_count").isNull(), "Failed").when(done, "Text (Auto-Corrected)").otherwise("Text").alias("method"))
    return fixed, status


def daily_net(txn: DataFrame) -> DataFrame:
    return txn.groupBy("file", "date").agg(F.sum("amount").cast(MONEY).alias("net"))


def inject_daily_gap(txn: DataFrame, balances: DataFrame) -> DataFrame:
    """A synthetic row for every day that does not return to the opening balance, and for a last day that does
    not reach the closing one.

    A day within a cent is left alone, so small remainders run on; they matter only in cents and are folded per
    file over its days (at most one entry per calendar day).
    """
    days = (daily_net(txn).join(balances.filter("bal_start is not null and bal_end is not null"), "file")
            .groupBy("file").agg(F.first("bal_start").alias("s"), F.first("bal_end").alias("e"),
                                 F.array_sort(F.collect_list(F.struct("date", "net"))).alias("days")))
    money = lambda c: c.cast(MONEY)
    start = F.struct(money(F.lit(0)).alias("off"), F.array().cast("array<struct<date:date,amount:decimal(18,2)>>").alias("rows"))

    def step(acc: Column, day: Column) -> Column:
        now = money(acc["off"] + day["net"])
        gap = F.abs(now) > 0.01
        return F.struct(F.when(gap, money(F.lit(0))).otherwise(now).alias("off"),
                        F.when(gap, F.concat(acc["rows"], F.array(F.struct(day["date"].alias("date"), money(-now).alias("amount")))))
                        .otherwise(acc["rows"]).alias("rows"))

    folded = days.withColumn("acc", F.aggregate(F.slice("days", 1, F.size("days") - 1), start, step))
    tail = F.element_at("days", -1)
    short = money(F.col("e") - F.col("s") - F.col("acc.off") - tail["net"])
    last = F.when(F.abs(short) > 0.01, F.array(F.struct(tail["date"].alias("date"), short.alias("amount")))).otherwise(
        F.array().cast("array<struct<date:date,amount:decimal(18,2)>>"))
    rows = (folded.select("file", F.inline(F.concat("acc.rows", last)))
            .withColumn("memo", F.lit(W.AUTO_MOVEMENT)).withColumn("source", F.lit("System")))
    return txn.withColumn("source", F.lit("Bank")).unionByName(rows, allowMissingColumns=True)


def extraction_audit(catalog: DataFrame, txn: DataFrame, balances: DataFrame, banks: DataFrame) -> DataFrame:
    """Per file row count, bank label, balance check and status. ``catalog``: file, suffix, bank_id."""
    checked = validate_balance(txn, balances)
    counts = txn.groupBy("file").agg(F.count("*").alias("tx_count"))
    code = F.coalesce("bank_id", F.lit(""))
    label = F.when(code == "", W.NOT_DETECTED).otherwise(
        F.concat(F.coalesce("bank_name", F.lit(W.UNKNOWN_BANK)), F.lit(" ("), code, F.lit(")")))
    return (catalog.join(checked, "file", "left").join(counts, "file", "left")
            .join(banks, catalog["bank_id"] == banks["code"], "left")
            .select("file", F.when(F.lower("suffix") != "pdf", "error")
                    .when(F.coalesce("is_valid", F.lit(True)), "success").otherwise("warning").alias("status"),
                    label.alias("bank"), F.coalesce("tx_count", F.lit(0)).alias("tx_count"), "is_valid", "msg", "bal_start", "bal_end"))


def deep_verify(txn: DataFrame, balances: DataFrame) -> DataFrame:
    """Duplicates by (date, amount, cleaned memo) and the balance discrepancy; PASS below 0.05.

    Counted from group sizes, so copies are added up map-side.
    """
    groups = txn.groupBy("file", "date", "amount", clean_desc("memo").alias("memo")).agg(F.count("*").alias("n"))
    per_file = groups.groupBy("file").agg(
        F.sum("n").alias("txns"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicates"),
        F.sum(F.col("amount") * F.col("n")).cast(MONEY).alias("sum_txns"))
    gap = (F.col("bal_end") - F.col("bal_start") - F.col("sum_txns")).cast(MONEY)
    return per_file.join(balances, "file", "left").select(
        "file", "txns", "duplicates", "sum_txns", gap.alias("discrepancy"),
        F.when(F.abs(gap) < 0.05, "PASS").otherwise("CHECK (Bal mismatch or no info)").alias("status"))


DATED_LINE = r"^\d{2}/\d{2}(?:/\d{4})?.*"
# fixed values: dated lines that are no transactions
DATED_HEADERS = ["Extrato conta corrente", "Período do", "Saldo Anterior"]


def coverage_audit(lines: DataFrame, txn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per file the lines that look like transactions and the rows read; and the lines without a row."""
    t = strip("text")
    looks = t.rlike(DATED_LINE) & ~t.rlike("|".join(DATED_HEADERS))
    candidates = lines.filter(looks)
    # tagged counts of both sides in one aggregation
    both = (candidates.select("file", F.lit(1).alias("c"), F.lit(0).alias("p"))
            .unionByName(txn.select("file", F.lit(0).alias("c"), F.lit(1).alias("p"))))
    counts = both.groupBy("file").agg(F.sum("c").alias("candidates"), F.sum("p").alias("parsed")).withColumn(
        "matches", F.col("candidates") == F.col("parsed"))
    return counts, candidates.join(txn, ["file", "page_no", "line_no"], "left_anti")


def null_audit(txn: DataFrame) -> DataFrame:
    """A21."""
    return txn.groupBy("file").agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("date", "amount", "memo")])


def load_status(ledger: DataFrame, bank: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per side, and a row for each ledger file: its name and place in name order, as many as a company has."""
    named = ledger.select(*keys, "source_file").distinct().withColumn(
        "place", F.row_number().over(Window.partitionBy(*keys).orderBy("source_file")))
    both = (ledger.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("b"))
            .unionByName(bank.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("b"))))
    return (both.groupBy(*keys).agg(F.sum("l").alias("ledger_count"), F.sum("b").alias("bank_count"))
            .join(named.withColumnRenamed("source_file", "ledger_name"), keys, "left"))


def ingest_errors(catalog: DataFrame, txn: DataFrame) -> DataFrame:
    """Requested files that are missing or gave no rows. ``catalog``: file, found."""
    got = txn.select("file").distinct()
    return catalog.join(got, "file", "left_anti").select(
        "file", F.when(~F.col("found"), F.concat(F.lit("Not found: "), F.col("file")))
        .otherwise(F.concat(F.lit("No transactions found for "), F.col("file"))).alias("error"))
