"""Named queries over the given tables, each with the SQL that must give the same rows where there is one."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LEDGER = """ledger AS (
  SELECT o_orderkey AS row_id, o_custkey % 40 AS account_id, CAST(o_orderdate AS DATE) AS date,
         CAST((CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END)
              * (CAST(floor(o_totalprice / 20000) AS BIGINT) + 1) * 12345 AS BIGINT) AS cents,
         o_orderpriority AS description, o_orderstatus AS st FROM orders)"""
BANK = """bank AS (
  SELECT row_id, account_id,
         CAST(CASE WHEN row_id % 3 = 0 THEN date + CAST(row_id % 9 - 4 AS INTEGER) ELSE date END AS DATE) AS date,
         cents, 'TX ' || description AS description
  FROM ledger WHERE NOT (st = 'P' AND description = '5-LOW'))"""
SIDES = f"WITH {LEDGER}, {BANK}"
# the same sides with rows that lack a date or an account
GAPS = f"""WITH {LEDGER.replace("ledger AS (", "ledger0 AS (", 1)}, {BANK.replace("bank AS (", "bank0 AS (", 1).replace("FROM ledger ", "FROM ledger0 ")},
ledger AS (SELECT * REPLACE (CASE WHEN row_id % 29 = 0 THEN NULL ELSE account_id END AS account_id, CASE WHEN row_id % 31 = 0 THEN NULL ELSE date END AS date) FROM ledger0),
bank AS (SELECT * REPLACE (CASE WHEN row_id % 29 = 0 THEN NULL ELSE account_id END AS account_id, CASE WHEN row_id % 31 = 0 THEN NULL ELSE date END AS date) FROM bank0)"""
MOV = """mov AS (
  SELECT o_orderkey AS row_id, o_custkey AS cust, 'stmt-' || (o_orderkey // 1000) AS file,
         CAST((o_orderkey % 1000) // 40 + 1 AS INTEGER) AS page_no, CAST((o_orderkey % 1000) % 40 AS INTEGER) AS slot,
         CAST(o_orderdate AS DATE) AS date, o_orderstatus = 'F' AS neg,
         (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) * CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         substr(o_orderpriority, 3) AS prio, 'MOV N' || o_orderkey || ' ' || substr(o_orderpriority, 3) AS memo
  FROM orders)"""
MOVES = f"WITH {MOV}"
COMBO = """cl AS (
  SELECT o_custkey AS account_id, CAST(CAST(o_orderdate AS DATE) + CAST(l_linenumber % 3 - 1 AS INTEGER) AS DATE) AS date, cents,
         l_orderkey * 8 + l_linenumber AS row_id
  FROM (SELECT l_orderkey, l_linenumber, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM lineitem GROUP BY 1, 2) JOIN orders ON l_orderkey = o_orderkey),
cb AS (
  SELECT o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date, cents, l_orderkey AS row_id
  FROM (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1)
  JOIN orders ON l_orderkey = o_orderkey)"""
COMBOS = f"WITH {COMBO}"
RAW = f"""{MOV}, raw AS (
  SELECT 'led-' || (row_id // 1000) AS file, row_id AS pos, 'T' || row_id AS transaction_id, CAST(cust AS VARCHAR) AS key,
         CASE WHEN prio = 'HIGH' THEN '31/02/2024' ELSE strftime(date, '%d/%m/%Y') END AS date,
         CASE WHEN neg THEN other ELSE '78' END AS debit_account, CASE WHEN neg THEN '78' ELSE other END AS credit_account,
         CASE WHEN prio = 'LOW' THEN 'sem valor' ELSE CAST(CAST(abs(cents) / 100.0 AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
         memo AS description, prio, cents, date AS real_date, cust
  FROM (SELECT *, CASE WHEN cust % 50 = 0 THEN '' ELSE CAST(cust % 50 + 1000 AS VARCHAR) END AS other FROM mov))"""
RAWS = f"WITH {RAW}"


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def load() -> None:
    """Import the modules that register queries."""
    from tallybook.plans import queries_files, queries_match, queries_report, queries_rows, queries_text  # noqa: F401
