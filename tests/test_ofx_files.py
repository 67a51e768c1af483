"""OFX documents as files, one per account."""
import datetime
import os
from collections import Counter
from decimal import Decimal as D

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybook.sinks.ofx_files import DocumentWriter, file_name, write_ofx
from tallybook.sinks.ofx_writer import to_ofx
from tallybook.sources.ofx_files import ofx_accounts, read_ofx

DDL = "company string, account_id long, row_id long, date date, amount decimal(18,2), memo string, type string, fitid string, doc_id string"
NOW = "20250101000000"


def moves(spark, n, company="a/b, ç", account=1):
    day = datetime.date(2024, 1, 1)
    return spark.createDataFrame([(company, account, i, day + datetime.timedelta(i % 90), D(i - 5) / 100, f"Saída – {i}", "x", f"F{i}", None) for i in range(n)], DDL)


def test_one_file_per_account_reads_back(spark, tmp_path):
    """A hot account over many input partitions, accounts with odd and null keys, one row each."""
    txn = moves(spark, 12_000).repartition(20).unionByName(moves(spark, 1, None, 7)).unionByName(moves(spark, 2, "a", None)).unionByName(moves(spark, 3, "..", 7))
    keys = ["company", "account_id"]
    write_ofx(txn, keys, str(tmp_path / "out"), NOW, bank_id="001")
    names = sorted(os.listdir(tmp_path / "out"))
    assert names == sorted(["a%2Fb%2C+%C3%A7,1.ofx", "%,7.ofx", "a,%.ofx", "%2E.,7.ofx"])
    back = read_ofx(spark, str(tmp_path / "out"))
    name = F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B")))
    want = txn.select(file_name(keys).alias("f"), "date", "amount", F.col("memo").alias("description"), "fitid")
    have = back.select(name.alias("f"), "date", "amount", "description", "fitid")
    assert want.exceptAll(have).take(3) == [] and have.exceptAll(want).take(3) == []
    hot = back.filter(F.col("file").contains("ofx")).groupBy("file").count().agg(F.max("count")).first()[0]
    assert hot == 12_000
    order = [r.fitid for r in back.filter("description like 'Saída%'").orderBy("file", "internal_id").collect()]
    assert [f for f, n in Counter(order).items() if n == 1][:3] == ["F3", "F4", "F5"]
    assert ofx_accounts(spark, str(tmp_path / "out")).filter("agency = '001'").count() == 4
    text = "\n".join(r.text for r in to_ofx(txn.filter("account_id is null"), keys, NOW, bank_id="001").orderBy("ord").collect())
    assert (tmp_path / "out" / "a,%.ofx").read_bytes().decode("cp1252") == text + "\n"


def test_replaced_kept_and_empty(spark, tmp_path):
    """A second export replaces its own accounts and leaves the others; without rows nothing is written; letters beyond the encoding are references."""
    path = str(tmp_path / "out")
    write_ofx(moves(spark, 3, "a").unionByName(moves(spark, 2, "b")), ["company"], path, NOW)
    write_ofx(moves(spark, 1, "a").withColumn("memo", F.lit("漢")), ["company"], path, NOW)
    write_ofx(moves(spark, 5, "a").limit(0), ["company"], path, NOW)
    rows = read_ofx(spark, path).groupBy(F.element_at(F.split("file", "/"), -1).alias("f")).count().collect()
    assert sorted((r.f, r["count"]) for r in rows) == [("a.ofx", 1), ("b.ofx", 2)]
    assert b"<MEMO>&#28450;</MEMO>" in (tmp_path / "out" / "a.ofx").read_bytes()
    assert sorted(os.listdir(path)) == ["a.ofx", "b.ofx"]


def test_attempts(tmp_path):
    """An attempt that died, one that was overtaken, and a retry: each document is there once and whole; an abort leaves nothing."""
    rows = [("x.ofx", "1"), ("x.ofx", "2"), ("y.ofx", "3")]

    def batches(some):
        for i in range(0, len(some), 2):
            yield pa.RecordBatch.from_pylist([{"name": n, "text": t} for n, t in some[i: i + 2]], pa.schema([("name", "string"), ("text", "string")]))

    def dying():
        yield from batches(rows[:1])
        raise OSError("lost")
    w = DocumentWriter(str(tmp_path / "out"), "utf-8")
    with pytest.raises(OSError):
        w.write(dying())
    w.write(batches(rows[:2]))
    w.commit([w.write(batches(rows)), None])
    assert {f: (tmp_path / "out" / f).read_text() for f in os.listdir(tmp_path / "out")} == {"x.ofx": "1\n2\n", "y.ofx": "3\n"}
    w = DocumentWriter(str(tmp_path / "out"), "utf-8")
    w.abort([w.write(batches([("y.ofx", "9")]))])
    assert (tmp_path / "out" / "y.ofx").read_text() == "3\n" and len(os.listdir(tmp_path / "out")) == 2
    with pytest.raises(ValueError, match="stand together"):
        w.write(batches([*rows, ("x.ofx", "4")]))
