"""Batches that join a table whole or not at all.

A batch is written to a folder of its own attempt. Then one small file, named by the batch, says which attempt counts; it appears by a rename that
never replaces another file. So a batch written twice counts once, one that ended half-way does not count, and batches
written at the same time do not touch each other's files. Readers see the attempts that such a file names, and nothing else.
"""
from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "batch string, attempt string"


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return hadoop, target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _commit_path(path: str, batch: str) -> str:
    return f"{path}/commits/{hashlib.sha256(batch.encode()).hexdigest()}.json"


def is_table(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds batches with commits."""
    _, target, files = _files(spark, f"{path}/commits")
    return files.exists(target)


def is_committed(spark: SparkSession, path: str, batch: str) -> bool:
    _, target, files = _files(spark, _commit_path(path, batch))
    return files.exists(target)


def _publish(spark: SparkSession, path: str, batch: str, text: str) -> bool:
    """Names the attempt of a batch; false if another one was named before. The rename is one step on file systems that have such a rename."""
    hadoop, target, files = _files(spark, _commit_path(path, batch))
    target = files.makeQualified(target)
    draft = hadoop.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(draft, target, plain)
    except Exception:
        files.delete(draft, False)
        if files.exists(target):
            return False
        raise
    return True


def add_batch(df: DataFrame, path: str, batch: str, fmt: str = "parquet", partition: list[str] | None = None) -> bool:
    """Adds a batch; false if the table has it already. A failed call may be made again."""
    spark = df.sparkSession
    if is_committed(spark, path, batch):
        return False
    attempt = f"a-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition or [])).format(fmt).save(f"{path}/data/attempt={attempt}")
    return _publish(spark, path, batch, json.dumps({"batch": batch, "attempt": attempt}))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(batch, attempt) of the table."""
    if not is_table(spark, path):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).json(f"{path}/commits")


def read_batches(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, batch: str = "batch") -> DataFrame:
    """The rows of all whole batches, with their batch as a column. ``schema``: needed if there may be no batch yet, and for text formats."""
    if schema and not is_table(spark, path):
        return spark.createDataFrame([], f"{schema}, {batch} string")
    reader = spark.read.format(fmt)
    rows = (reader.schema(f"{schema}, attempt string") if schema else reader).load(f"{path}/data")
    own = commits(spark, path).select("attempt", F.col("batch").alias(batch))
    return rows.join(own, "attempt").drop("attempt")
