"""Structured Streaming: statement ingest and activity counts.

A sink of either stream is a folder for each micro-batch, which a repeated batch replaces, and a reader that puts the folders together.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallybook.operators.clean import drop_zero
from tallybook.operators.extract_lines import extract_cef
from tallybook.operators.ordering import join_whole
from tallybook.schemas import ACTIVITY, LINES
from tallybook.sinks.commits import COMMIT

PLACE = ["file", "page_no", "line_no"]
PAGE = ("file", "page_no")
#: State lies on the executors' disks, and a batch saves what it changed, not all there is.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_SEEN = "page_no array<int>, line_no array<int>, text array<string>"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that a query takes with it when it starts."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _values(column: pd.Series) -> list:
    """Plain values; a number column with nulls comes as floats."""
    out = column.tolist()
    if column.dtype.kind == "f":
        return [None if v != v else int(v) for v in out]
    return [None if v is pd.NA or v != v else v for v in out] if column.dtype.kind != "i" else out


def _gather(names: Sequence[str], keep_ms: int | None) -> Callable:
    """State of one unit: its lines so far, kept as plain values, as a data frame for each unit costs more than the work. A unit with new lines comes out whole, one with known lines only does not come out."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(zip(*state.get[:2], strict=True), state.get[2], strict=True)) if state.exists else {}
        known, new, now = len(held), [], 0
        for frame in frames:
            new += zip(*[_values(frame[c]) for c in ("page_no", "line_no", "text")], strict=True)
            now = max(now, int(frame["now"].max())) if keep_ms else now
        for page_no, line_no, text in sorted(new, key=lambda x: [(v is None, v) for v in x]) if len(set(new)) > 1 else new:
            held.setdefault((page_no, line_no), text)
        if keep_ms:
            state.setTimeoutTimestamp(max(now + keep_ms, state.getCurrentWatermarkMs() + 1))
        if known and len(held) == known:
            return
        places, lines, texts = [p for p, _ in held], [n for _, n in held], list(held.values())
        state.update((places, lines, texts))
        yield pd.DataFrame({"file": None, "page_no": places, "line_no": lines, "text": texts} | dict(zip(names, key, strict=True)))
    return run


def stream_bank(spark: SparkSession, source: str, sink: str, checkpoint: str, rule=extract_cef, unit: Sequence[str] = PAGE, keep: int | None = None,
                skew: str = "1 hour") -> StreamingQuery:
    """New LINES files -> bank rows; zero rows out, the same physical line once, however late it comes again.

    ``unit`` is what the rule reads as a whole: a page, or ("file",) for rules that carry dates or texts over pages. The state holds the lines of each unit. A
    unit may arrive in any number of parts, in any order: whenever a line is new, the rule reads the unit anew, and its rows take the place of
    those before (``read_bank``). Of different texts for one line the first stays. What a batch costs depends on the units that
    it touches, not on what came before. ``keep``: milliseconds after its last arrival, and after ``skew``, by which
    the clocks of two runs may differ, that a unit is forgotten (None: never); what comes later is read as a unit of its own and replaces the rows.
    """
    def add(lines: DataFrame, batch: int) -> None:
        session = lines.sparkSession
        path = f"{sink}/lines/batch={batch}"
        lines.write.mode("overwrite").parquet(path)
        whole = session.read.schema(LINES).parquet(path)
        whole.select(*unit).distinct().write.mode("overwrite").parquet(f"{sink}/units/batch={batch}")
        drop_zero(rule(whole)).withColumn("arrived", F.current_timestamp()).write.mode("overwrite").parquet(f"{sink}/rows/batch={batch}")

    lines = spark.readStream.schema(LINES).parquet(source)
    if keep:
        lines = lines.withColumn("arrived", F.current_timestamp()).withColumn("now", F.unix_millis("arrived")).withWatermark("arrived", skew)
    timeout = GroupStateTimeout.EventTimeTimeout if keep else GroupStateTimeout.NoTimeout
    units = lines.groupBy(*unit).applyInPandasWithState(_gather(unit, keep), LINES, _SEEN, "update", timeout)
    with _settings(spark, STATE):
        return units.writeStream.foreachBatch(add).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_bank(spark: SparkSession, sink: str) -> DataFrame:
    """The bank rows of a T1 sink: of each unit, those of the last batch that brought it a new line."""
    rows, units = spark.read.parquet(f"{sink}/rows"), spark.read.parquet(f"{sink}/units")
    unit = [c for c in units.columns if c != "batch"]
    last = units.groupBy(*unit).agg(F.max("batch").alias("batch"))
    return join_whole(rows, last, [*unit, "batch"], "left_semi")


def activity_counts(events: DataFrame) -> DataFrame:
    """Events per day, category and user."""
    return (events.groupBy(F.to_date("timestamp").alias("day"), "category", F.coalesce("user", "username").alias("user")).agg(F.count("*").alias("n")))


def stream_activity(spark: SparkSession, source: str, sink: str, checkpoint: str, most: int = 1_000) -> StreamingQuery:
    """Counts of each micro-batch of an activity log (``append_activity``).

    The stream follows the log's commits, at most ``most`` in a micro-batch, and reads the batches that they name. Counts add up, so no
    watermark closes a day: events of any age count, and the days still open are there.
    """
    def add(new: DataFrame, batch: int) -> None:
        session = new.sparkSession
        paths = [f"{source}/data/attempt={r.attempt}" for r in new.select("attempt").collect()]          # ``most`` rows
        events = session.read.schema(ACTIVITY).option("recursiveFileLookup", "true").json(paths) if paths else session.createDataFrame([], ACTIVITY)
        activity_counts(events).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    named = spark.readStream.schema(COMMIT).option("maxFilesPerTrigger", most).json(f"{source}/commits")
    return named.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_activity_counts(spark: SparkSession, sink: str) -> DataFrame:
    """The counts of a T2 sink."""
    return spark.read.parquet(sink).groupBy("day", "category", "user").agg(F.sum("n").alias("n"))
