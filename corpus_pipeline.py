"""From raw documents to token ids: score, deduplicate, cut, mix, encode."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm import bpe, mixing, simhash, substring_dedup, toxicity
from tallybook.session import scratch_path

#: Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash near-dedup", simhash.stage),
    ("substring dedup", substring_dedup.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]
#: Trained scores, Golay codes, pseudorandom draws and merges are not for SQL; tests compare each stage and the whole with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over documents; what each stage returns goes through the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
