"""OFX output: the document as ordered text blocks per account."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.scalars import surrogate_id
from tallybook.operators.ordering import id_block, ordinal
from tallybook.schemas import MONEY

# fixed values: document header and kept transaction types
HEADER = ["OFXHEADER:100", "DATA:OFXSGML", "VERSION:102", "SECURITY:NONE", "ENCODING:UTF-8", "CHARSET:1252", "COMPRESSION:NONE",
          "OLDFILEUID:NONE", "NEWFILEUID:NONE"]
TYPES = ["DEBIT", "CREDIT", "OTHER", "PAYMENT", "DEP"]


def _lines(depth: int, *parts) -> list[Column]:
    pad = F.lit("  " * depth)
    return [F.concat(pad, F.lit(p) if isinstance(p, str) else p) for p in parts]


def _tag(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), F.lit(value) if isinstance(value, str) else value, F.lit(f"</{name}>"))


def ofx_row(txn: DataFrame) -> DataFrame:
    """K4: type by list or sign, FITID kept or derived, CHECKNUM only with a document."""
    kind = F.upper("type")
    kind = F.when(kind.isin(TYPES), kind).when(F.col("amount") < 0, "DEBIT").otherwise("CREDIT")
    ident = F.coalesce(F.nullif("fitid", F.lit("")), surrogate_id(F.col("date"), F.col("amount"), F.col("memo")))
    return txn.select("*", kind.alias("trntype"), F.date_format("date", "yyyyMMddHHmmss").alias("dtposted"),
                      F.col("amount").cast(MONEY).cast("string").alias("trnamt"), ident.alias("ident"),
                      F.nullif("doc_id", F.lit("")).alias("checknum"))


def ofx_block(txn: DataFrame) -> DataFrame:
    """One <STMTTRN> block of text per row."""
    rows = ofx_row(txn)
    tags = [_tag("TRNTYPE", F.col("trntype")), _tag("DTPOSTED", F.col("dtposted")), _tag("TRNAMT", F.col("trnamt")), _tag("FITID", F.col("ident"))]
    check = F.concat(F.lit("          "), _tag("CHECKNUM", F.col("checknum")))
    text = F.concat_ws("\n", *_lines(5, "<STMTTRN>"), *_lines(6, *tags), check, *_lines(6, _tag("MEMO", F.coalesce("memo", F.lit("")))),
                       *_lines(5, "</STMTTRN>"))
    return rows.withColumn("text", text)


def to_ofx(txn: DataFrame, keys: list[str], now: str, seq: str = "row_id", bank_id: str = "000", acct_id: str = "00000",
           currency: str = "BRL") -> DataFrame:
    """K3: (keys, ord, text); the texts of an account joined by newlines in ``ord`` order are its document.

    A document is never put together in one task: a large account stays many rows.
    """
    # numbered first: what is stored and sorted for the numbers are rows, not their texts
    body = ofx_block(ordinal(txn.withColumn("__blk", id_block(seq)), keys, ["__blk"], [seq], "ord")).select(*keys, "ord", "text")
    span = txn.groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count("*").alias("n"))
    status = lambda d: _lines(d, "<STATUS>") + _lines(d + 1, _tag("CODE", "0"), _tag("SEVERITY", "INFO")) + _lines(d, "</STATUS>")
    head = [*map(F.lit, HEADER), F.lit("<OFX>"), *_lines(1, "<SIGNONMSGSRSV1>"), *_lines(2, "<SONRS>"), *status(3),
            *_lines(3, _tag("DTSERVER", now), _tag("LANGUAGE", "POR")), *_lines(2, "</SONRS>"), *_lines(1, "</SIGNONMSGSRSV1>", "<BANKMSGSRSV1>"),
            *_lines(2, "<STMTTRNRS>"), *_lines(3, _tag("TRNUID", "1001")), *status(3), *_lines(3, "<STMTRS>"),
            *_lines(4, _tag("CURDEF", currency), "<BANKACCTFROM>"),
            *_lines(5, _tag("BANKID", bank_id), _tag("ACCTID", acct_id), "<ACCTTYPE>CHECKING</ACCTTYPE>"), *_lines(4, "</BANKACCTFROM>", "<BANKTRANLIST>"),
            *_lines(5, _tag("DTSTART", F.date_format("lo", "yyyyMMdd'000000'")), _tag("DTEND", F.date_format("hi", "yyyyMMdd'235959'")))]
    tail = [*_lines(4, "</BANKTRANLIST>", "<LEDGERBAL>"), *_lines(5, _tag("BALAMT", "0.00"), _tag("DTASOF", now)), *_lines(4, "</LEDGERBAL>"),
            *_lines(3, "</STMTRS>"), *_lines(2, "</STMTTRNRS>"), *_lines(1, "</BANKMSGSRSV1>"), F.lit("</OFX>")]
    first = span.select(*keys, F.lit(0).cast("bigint").alias("ord"), F.concat_ws("\n", *head).alias("text"))
    last = span.select(*keys, (F.col("n") + 1).alias("ord"), F.concat_ws("\n", *tail).alias("text"))
    return first.unionByName(body).unionByName(last)
