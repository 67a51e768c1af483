"""What stays on disk between the steps of a job."""
import os
import time

from pyspark.sql import functions as F

from tallybook.operators.clean import dedup_statement
from tallybook.plans.extract import extract_statements
from tallybook.session import CLEANUP, shared_dir, stored
from tallybook.sources.catalog import shipped_layouts


def exchanges(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if "/shuffle_" in f and os.path.exists(f)}


def test_exchanges_go_when_a_table_is_written(spark):
    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("n"))
    before, mode = exchanges(spark), spark.conf.get(CLEANUP)
    assert stored(df).count() == 100 and spark.conf.get(CLEANUP) == mode
    counted = {f for f in exchanges(spark) - before if f.endswith(".data")}
    until = time.time() + 20
    while len(counted & exchanges(spark)) > 1 and time.time() < until:      # the count's own exchange stays
        time.sleep(0.2)
    assert len(counted & exchanges(spark)) <= 1


def test_page_texts_go_and_words_of_a_page_without_text_are_read(spark):
    pages = spark.createDataFrame([("s", 1, "Internet Banking\n05/03/2024 PIX + R$ 10,00"), ("s", 2, None), ("x", 1, "nada")], "file string, page_no int, text string")
    words = spark.createDataFrame([("s", 2, 30.0, 100.0, "06/03/2024"), ("s", 2, 100.0, 100.0, "TED"), ("s", 2, 400.0, 100.0, "7,00"), ("x", 1, 30.0, 100.0, "07/03/2024")],
                                  "file string, page_no int, x0 double, top double, text string")
    there = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    out = extract_statements(pages, words, shipped_layouts(), 2024)
    assert sorted((r.file, r.page_no, str(r.date), float(r.amount)) for r in out.txn.collect()) == [("s", 1, "2024-03-05", 10.0), ("s", 2, "2024-03-06", 7.0)]
    assert {(r.file, r.method, r.tx_count) for r in out.status.collect()} == {("s", "Text", 2), ("x", "unknown", 0)}
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - there
    assert any(x.startswith("lines-") for x in left) and not any(x.startswith("pages-") for x in left)


def test_of_rows_in_one_place_the_smallest_stays(spark):
    rows = [("f", 1, 2, "a", "7"), ("f", 1, 2, "a", None), ("f", 1, 3, "a ", "1"), ("f", None, 1, "b", "2"), (None, 1, 1, "a", "3"), (None, 1, 1, "a", "3")]
    txn = spark.createDataFrame(rows, "file string, page_no int, line_no int, memo string, doc_id string").selectExpr(
        "file", "page_no", "line_no", "date '2024-01-01' AS date", "cast(1 AS decimal(18,2)) AS amount", "memo", "doc_id", "cast(null AS decimal(18,2)) AS balance")
    got = {(r.file, r.page_no, r.line_no, r.memo, r.doc_id, r.internal_id) for r in dedup_statement(txn).collect()}
    assert got == {("f", 1, 2, "a", None, 0), ("f", None, 1, "b", "2", 1), (None, 1, 1, "a", "3", 0)}
