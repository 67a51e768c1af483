"""Session defaults and the shared folder for cut lineage and exchange files."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # text rules cost CPU, not bytes: keep small shuffles spread over the cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PACKED = "zstd"     # for texts and rows that are written between the steps of a long job


def local_session(cores: int | str = 8, app: str = "tallybook") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.driver.memory", "12g"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (spark.checkpoint.dir, or what setCheckpointDir was given).

    Where none is named, a local session gets a folder of its own; a cluster's executors could not share that, so there it is an error.
    What is written below it belongs to the job: the cluster removes it with the folder, a local session's at its end.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="tallybook-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        else:
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers of the session, which need not see the folder it lies in."""
    if getattr(spark.sparkContext, "_tallybook_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tallybook-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tallybook", "zip", os.path.dirname(here), "tallybook"))
    spark.sparkContext._tallybook_shipped = True


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, path: str, *by: str, compression: str = "snappy") -> DataFrame:
    """Written as Parquet, in a folder for each value of ``by``, and read back. The exchanges of the writing go with its end: what is written is all that is read again.
    Else they stay until the driver collects its garbage, the more of them the larger the tables."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).partitionBy(*by).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Takes away a scratch table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Written once as Parquet and read back: later steps read only the columns they use, and survive lost executors."""
    return write_once(df, scratch_path(df.sparkSession, "stored"), compression=compression)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
