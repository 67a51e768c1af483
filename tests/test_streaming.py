import datetime
import threading

import pytest

from tallybook.operators import extract_lines as X
from tallybook.operators.clean import append_batch, drop_zero
from tallybook.plans.queries_text import bb_dot_lines
from tallybook.session import cut_lineage
from tallybook.sinks import commits as C
from tallybook.sinks.files import append_activity
from tallybook.streaming import ingest as I

TEXT = ["01/02/2025 000001 PIX RECEBIDO 100,00 C 100,00 C", "02/02/2025 000002 TARIFA 0,00 D 100,00 C", "03/02/2025 000003 COMPRA 30,00 D 70,00 C", "03/02/2025 000004 SAQUE 20,00 D 50,00 C"]


def rows_of(df):
    return sorted((r.file, r.page_no, r.line_no, str(r.date), str(r.amount), r.memo) for r in df.collect())


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State is kept for each partition, and a stream keeps the number it began with."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture
def feed(spark, tmp_path):
    source, sink = str(tmp_path / "lines"), str(tmp_path / "bank")

    def run(lines, **settings):
        lines.write.mode("append").parquet(source)
        I.stream_bank(spark, source, sink, sink + "-state", **settings).awaitTermination()
        return I.read_bank(spark, sink)
    run.sink = sink
    return run


def test_a_page_in_parts_gives_the_batch_rows(spark, feed):
    # rows that take texts from the lines below them, and parts that come in the wrong order
    whole = cut_lineage(bb_dot_lines(spark, "/root/testdata/sf0.001").filter("page_no < 4"))
    want = rows_of(drop_zero(X.extract_bb_dot(whole)))
    parts = [whole.filter(f"line_no % 3 = {i}") for i in (1, 2, 0)]
    for some in (*parts, whole):                                 # each run starts again from the checkpoint
        got = feed(some, rule=X.extract_bb_dot)
    assert rows_of(got) == want and want


def test_cost_follows_the_batch_not_the_history(spark, lines, feed):
    history = lines(*["\n".join(TEXT)] * 40)
    feed(history)
    got = feed(lines("\n".join(TEXT), file="new").unionByName(history.limit(50)))
    assert spark.read.parquet(f"{feed.sink}/lines/batch=1").count() == 4
    assert rows_of(got) == rows_of(drop_zero(X.extract_cef(history.unionByName(lines("\n".join(TEXT), file="new")))))


def test_file_as_unit_and_repeats(spark, lines, feed):
    whole = lines("\n".join(TEXT), "\n".join(TEXT))
    for some in (whole.filter("page_no = 2"), whole, whole, whole.filter("page_no = 1")):
        got = feed(some, unit=("file",))
    assert rows_of(got) == rows_of(drop_zero(X.extract_cef(whole)))
    assert [spark.read.parquet(f"{feed.sink}/lines/batch={b}").count() for b in range(4)] == [4, 8, 0, 0]


def test_a_unit_is_forgotten_after_its_time(spark, lines, feed):
    short = {"keep": 1, "skew": "0 seconds"}
    whole = lines("\n".join(TEXT))
    for some in (whole, lines("x", file="other")):               # time goes on with each batch that has rows
        feed(some, **short)
    got = feed(whole, **short)
    assert rows_of(got.filter("file = 'f'")) == rows_of(drop_zero(X.extract_cef(whole)))
    counts = spark.read.parquet(f"{feed.sink}/lines").filter("file = 'f'").groupBy("batch").count().collect()
    assert sorted(r["count"] for r in counts) == [4, 4]          # read anew, not known any more


def test_late_events_count_and_the_last_day_is_there(spark, tmp_path):
    path, sink = str(tmp_path / "log"), str(tmp_path / "counts")

    def events(*days):
        rows = [(datetime.datetime(2025, 1, d, 12), "u", "a", "upload", {"k": "v"}) for d in days]
        return spark.createDataFrame(rows, "timestamp timestamp, user string, action string, category string, details map<string,string>")
    for batch, days in (("one", (9, 10, 10)), ("two", (6, 12)), ("one", (9, 10, 10)), ("three", (6, 10))):
        append_activity(events(*days), path, batch)
        I.stream_activity(spark, path, sink, sink + "-state").awaitTermination()
    got = {r.day.day: r.n for r in I.read_activity_counts(spark, sink).collect()}
    assert got == {6: 2, 9: 1, 10: 3, 12: 1}


def test_batches_count_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "table")
    assert C.read_batches(spark, path, schema="id long").count() == 0
    df = spark.range(10)
    assert append_batch(df, path, "a") and not append_batch(df, path, "a")
    df.write.parquet(f"{path}/data/attempt=a-dead")              # ended before its commit
    done = []
    threads = [threading.Thread(target=lambda b=b: done.append((b, append_batch(df, path, b)))) for b in ("b", "c", "d", "d", "d")]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(b for b, ok in done if ok) == ["b", "c", "d"]
    assert {(r.batch, r.n) for r in C.read_batches(spark, path).groupBy("batch").count().withColumnRenamed("count", "n").collect()} == {(b, 10) for b in "abcd"}


def test_state_of_a_unit_needs_no_data_frames(monkeypatch):
    """A unit with nulls, repeats and two texts for one line; state goes in and comes out as plain values."""
    import pandas as pd

    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value
    state, run = State(), I._gather(I.PAGE, None)
    monkeypatch.setattr(pd, "concat", None)

    def feed(*rows):
        frame = pd.DataFrame(rows, columns=["page_no", "line_no", "text"])
        return [list(out.itertuples(index=False, name=None)) for out in run(("f", 1), iter([frame[:1], frame[1:]]), state)]
    assert feed((1, 3, "c"), (1, 1, "b"), (1, 1, "a"), (1, 2, None)) == [[("f", 1, 1, "a"), ("f", 1, 2, None), ("f", 1, 3, "c")]]
    assert feed((1, 3, "c"), (1, 1, "other")) == []
    assert [len(out) for out in feed((1, None, "x"), (1, 0, "z"), (1, None, "x"))] == [5]
    assert state.get == ([1] * 5, [1, 2, 3, 0, None], ["a", None, "c", "z", "x"])
