"""Inputs derived by Spark from the given tables: whole tables, row-wise expressions, no collecting."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.scalars import fmt_brl, from_cents

KEYS = ["account_id"]
ROWS_PER_FILE, ROWS_PER_PAGE, LINES_PER_ROW = 1000, 40, 10
ROWS_PER_TASK = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt over tasks by their keys: a table that lies in one piece keeps more than one task busy, and what a task holds does not grow with it."""
    tasks = -(-rows // ROWS_PER_TASK)
    many = [tasks] if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    return df.repartition(*many, *keys)


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEDGER: few distinct amounts per account, so amounts repeat and conflicts are real."""
    sign = F.when(F.col("o_orderstatus") == "F", F.lit(-1)).otherwise(F.lit(1))
    step = F.floor(F.col("o_totalprice") / 20000).cast("bigint") + 1
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 40).alias("account_id"),
        F.col("o_orderdate").cast("date").alias("date"), (sign * step * 12345).cast("bigint").alias("cents"),
        F.col("o_orderpriority").alias("description"), F.col("o_orderstatus").alias("status_flag"))


def orders_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BANK: the same movements, some posted days off, pending low-priority ones not posted yet."""
    led = orders_ledger(spark, sf_dir)
    shift = F.when(F.col("row_id") % 3 == 0, (F.col("row_id") % 9 - 4).cast("int")).otherwise(F.lit(0))
    return (led.filter(~((F.col("status_flag") == "P") & (F.col("description") == "5-LOW")))
            .select("row_id", "account_id", F.date_add("date", shift).alias("date"), "cents",
                    F.concat(F.lit("TX "), F.col("description")).alias("description")))


def ledger_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_ledger(spark, sf_dir).drop("status_flag")


def with_amount(df: DataFrame) -> DataFrame:
    return df.withColumn("amount", from_cents("cents"))


def combo_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as ledger rows of the customer's account; (order, line) repeats in the data and is summed."""
    item = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
            .agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents")))
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("od"))
    return (item.join(order, item.l_orderkey == order.o_orderkey)
            .select(F.col("o_custkey").alias("account_id"),
                    F.date_add("od", (F.col("l_linenumber") % 3 - 1).cast("int")).alias("date"), "cents",
                    (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
                    F.concat(F.lit("ITEM "), F.col("l_linenumber").cast("string")).alias("description")))


def combo_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bank row per order: the sum of its items."""
    item = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
            .agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents")))
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"))
    return (item.join(order, item.l_orderkey == order.o_orderkey)
            .select(F.col("o_custkey").alias("account_id"), "date", "cents", F.col("l_orderkey").alias("row_id"),
                    F.concat(F.lit("ORDER "), F.col("l_orderkey").cast("string")).alias("description")))


# ---- statement texts -----------------------------------------------------------------------------

def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement row per order with its place: file, page, slot on the page."""
    o = table(spark, sf_dir, "orders")
    neg = F.col("o_orderstatus") == "F"
    mag = F.round(F.col("o_totalprice") * 100).cast("bigint")
    n = F.col("o_orderkey") % ROWS_PER_FILE
    mov = o.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("cust"),
        F.concat(F.lit("stmt-"), F.floor(F.col("o_orderkey") / ROWS_PER_FILE).cast("string")).alias("file"),
        (F.floor(n / ROWS_PER_PAGE) + 1).cast("int").alias("page_no"), (n % ROWS_PER_PAGE).cast("int").alias("slot"),
        F.col("o_orderdate").cast("date").alias("date"), F.when(neg, -mag).otherwise(mag).alias("cents"),
        F.expr("substr(o_orderpriority, 3)").alias("prio"))
    # statements arrive as many files; the rules' page windows then need no shuffle of their own
    return dealt(mov, o.count(), "file", "page_no").withColumn("mag_txt", fmt_brl(F.abs(from_cents("cents")))) \
     .withColumn("neg", F.col("cents") < 0) \
     .withColumn("memo", F.concat(F.lit("MOV N"), F.col("row_id").cast("string"), F.lit(" "), F.col("prio"))) \
     .withColumn("dc", F.when(F.col("neg"), "D").otherwise("C"))


def to_lines(mov: DataFrame, body: list[Column], header: list[Column] | None = None,
             footer: list[Column] | None = None) -> DataFrame:
    """LINES: the body lines of every movement, headers before slot 0, footers after the last slot. Null lines are left out."""
    none = F.array().cast("array<string>")
    head = F.when(F.col("slot") == 0, F.array(*header)).otherwise(none) if header else none
    foot = F.when(F.col("slot") == ROWS_PER_PAGE - 1, F.array(*footer)).otherwise(none) if footer else none
    texts = F.concat(head, F.array(*body), foot)
    return (mov.select("file", "page_no", "slot", F.posexplode(texts).alias("i", "text")).filter("text is not null")
            .select("file", "page_no", (F.col("slot") * LINES_PER_ROW + F.col("i")).cast("int").alias("line_no"), "text"))


def to_words(mov: DataFrame, words: list[tuple], gap: int = 12) -> DataFrame:
    """WORDS: (x0, text, line-in-row) per movement; a text of several words is split and spread to the right."""
    def spread(x: float, text: Column, dy: int) -> Column:
        return F.transform(F.split(text, " "), lambda w, i: F.struct(
            (F.lit(float(x)) + i * 0.5).alias("x0"), F.lit(dy).alias("dy"), w.alias("text")))

    items = [spread(*w) for w in words]
    cells = F.filter(F.concat(*[F.coalesce(i, F.array().cast("array<struct<x0:double,dy:int,text:string>>")) for i in items]),
                     lambda w: F.length(w["text"]) > 0)
    return (mov.select("file", "page_no", "slot", F.explode(cells).alias("w"))
            .select("file", "page_no", F.col("w.x0").alias("x0"),
                    (F.lit(100.0) + F.col("slot") * gap * 4 + F.col("w.dy") * gap).alias("top"), F.col("w.text").alias("text")))


def date_br(pattern: str = "dd/MM/yyyy") -> Column:
    return F.date_format("date", pattern)


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEDGER_RAW: account 78 against a counter account, amounts unsigned, some dates and amounts unreadable."""
    mov = movements(spark, sf_dir)
    other = F.when(F.col("cust") % 50 == 0, F.lit("")).otherwise((F.col("cust") % 50 + 1000).cast("string"))
    here = F.lit("78")
    return mov.select(
        F.regexp_replace("file", "stmt", "led").alias("file"), F.col("row_id").alias("pos"),
        F.concat(F.lit("T"), F.col("row_id").cast("string")).alias("transaction_id"), F.col("cust").cast("string").alias("key"),
        F.when(F.col("prio") == "HIGH", "31/02/2024").otherwise(date_br()).alias("date"),
        F.when(F.col("neg"), other).otherwise(here).alias("debit_account"),
        F.when(F.col("neg"), here).otherwise(other).alias("credit_account"),
        F.when(F.col("prio") == "LOW", "sem valor").otherwise(F.abs(from_cents("cents")).cast("string")).alias("amount"),
        F.col("memo").alias("description"))
