"""Splittable text reading with the place of each line in its file."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: the letters code page 1252 has at 0x80-0x9F; five codes are undefined and dropped
CP1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š",
    0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—",
    0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}


def latin1(raw: Column) -> Column:
    return F.decode(raw.cast("binary"), "ISO-8859-1")


def cp1252(raw: Column) -> Column:
    """Bytes as code page 1252; undefined bytes are dropped. Only texts with a letter that differs go through the letter-by-letter translation."""
    undefined = [c for c in range(0x80, 0xA0) if c not in CP1252]
    source = "".join(map(chr, [*CP1252, *undefined]))
    plain = latin1(raw)
    return F.when(plain.rlike(r"[\x80-\x9f]"), F.translate(plain, source, "".join(CP1252.values()))).otherwise(plain)


def read_records(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(file, pos, value): ``file`` is the path, ``pos`` grows with the place in the file.

    Large files are split over tasks. A record's pos is the byte offset of its split plus its number inside the
    split; a split never has more records than bytes, so the order holds across splits.
    """
    raw = spark.read.option("lineSep", separator).option("recursiveFileLookup", "true").text(path)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return raw.select(F.col("_metadata.file_path").alias("file"),
                      (F.col("_metadata.file_block_start") + local).alias("pos"), F.col("value"))


def head_lines(records: DataFrame, n: int) -> DataFrame:
    """The first n records of each file, numbered from 0; cut per task before the shuffle."""
    w = Window.partitionBy("file").orderBy("pos")
    return records.withColumn("idx", F.row_number().over(w)).filter(F.col("idx") <= n).withColumn("idx", F.col("idx") - 1)


def with_source_file(df: DataFrame) -> DataFrame:
    """The file every scanned row came from."""
    return df.select("*", F.col("_metadata.file_name").alias("source_file"))


def read_statement_lines(spark: SparkSession, path: str) -> DataFrame:
    """LINES from a table (file, page_no, text) of page texts."""
    pages = spark.read.parquet(path)
    return page_lines(pages)


def page_lines(pages: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Page texts -> LINES."""
    return (pages.select("file", "page_no", *(extra or []), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
            .filter("text is not null"))
