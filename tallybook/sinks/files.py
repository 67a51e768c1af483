"""Writers. Sorted output is range-partitioned, so a large account becomes several ordered parts."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.operators.match import split
from tallybook.sinks.commits import add_batch


def write_ordered_text(df: DataFrame, keys: list[str], path: str, order: str = "ord", text: str = "text") -> None:
    """Lines per key folder in order (K1, K3); part names follow the order."""
    sorted_ = df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    sorted_.select(*keys, F.col(text).alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def divergences(ledger: DataFrame, bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K5: (bank rows not in the ledger, ledger rows not in the bank) of tagged sides."""
    return split(bank)[1], split(ledger)[1]


def write_divergences(ledger: DataFrame, bank: DataFrame, path: str) -> None:
    """K5 as CSV."""
    for name, df in zip(("not_in_ledger", "not_in_bank"), divergences(ledger, bank)):
        df.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")


def upload_event(filename: Column, file_type: Column, user: Column, ts: Column) -> list[Column]:
    """K7: columns of an upload event."""
    return [ts.alias("timestamp"), user.alias("user"), F.concat(F.lit("Upload: "), filename).alias("action"), F.lit("upload").alias("category"),
            F.create_map(F.lit("filename"), filename, F.lit("type"), file_type).alias("details")]


def process_event(filename: Column, summary: Column, details: Column, user: Column, ts: Column) -> list[Column]:
    """K7: columns of a processing event."""
    return [ts.alias("timestamp"), user.alias("user"), F.concat(F.lit("Processamento: "), filename, F.lit(" → "), summary).alias("action"),
            F.lit("process").alias("category"), details.alias("details")]


def append_activity(events: DataFrame, path: str, batch_id: str | None = None) -> bool:
    """K7: one folder per day, as JSON. A batch named by ``batch_id`` counts once, however often it is written; without a name each call is a batch."""
    return add_batch(events.withColumn("day", F.to_date("timestamp")), path, batch_id or uuid.uuid4().hex, "json", ["day"])
