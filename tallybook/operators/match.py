"""One-to-one matching of ledger and bank rows.

Both sides carry ``keys``, ``row_id`` (unique), ``date`` and ``cents``. Rows of one side that share
(keys, cents, date) differ only in their place in line, so the greedy matching is decided on *counts* per
day: a class (keys, cents) never has more entries than calendar days, however many rows it holds. The
decisions ("ledger places 4-9 of that day take bank places 1-6 of this day") are then handed back to the
rows by their place. No candidate pairs are formed.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.operators.ordering import exclusive_prefix, id_block, join_sorted, ordinal
from tallybook.session import stored


def with_rank(df: DataFrame, keys: list[str]) -> DataFrame:
    """Place of each row in its account in (date, cents, row_id) order."""
    return (ordinal(df.withColumn("__blk", id_block()), keys, ["date", "cents", "__blk"], ["row_id"], "rank")
            .drop("__blk"))


def _place(df: DataFrame, cls: list[str]) -> DataFrame:
    """Place in line ``k`` inside a class of interchangeable rows."""
    return ordinal(df.withColumn("__blk", id_block()), cls, ["__blk"], ["row_id"], "k").drop("__blk")


def match_exact(ledger: DataFrame, bank: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th ledger row of a day and amount takes the k-th bank row of that day and amount."""
    cls = [*keys, "date", "cents"]
    lhs = _place(ledger.select(*cls, "row_id"), cls).withColumnRenamed("row_id", "ledger_id")
    rhs = _place(bank.select(*cls, "row_id"), cls).withColumnRenamed("row_id", "bank_id")
    return lhs.join(rhs, [*cls, "k"]).select(*keys, "date", "cents", "ledger_id", "bank_id")


# ---- count-level greedy --------------------------------------------------------------------------

def _fold(n_keys: int, tol: int, by_sign: bool):
    """Streaming greedy over day counts sorted by (class, time, supply first).

    A supply entry arrives ``tol`` days early, so when a demand entry comes all its partners are known;
    entries older than ``tol`` days are dropped. State is one date window of one class.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, pool = None, []
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                cls = row[: n_keys + 1]
                kind, day, sgn, start, n = row[n_keys + 2:]
                if cls != current:
                    current, pool = cls, []
                if kind == 0:
                    pool.append([day, sgn, start, n])
                    continue
                pool = [s for s in pool if s[3] > 0 and s[0] >= day - tol]
                if by_sign:
                    order = sorted(pool, key=lambda s: (s[1] != sgn, s[0]))
                else:
                    order = sorted(pool, key=lambda s: (abs(s[0] - day), s[0]))
                for s in order:
                    if n == 0:
                        break
                    take = min(n, s[3])
                    out.append((*cls, day, sgn, start + 1, s[0], s[1], s[2] + 1, take))
                    start, n = start + take, n - take
                    s[2], s[3] = s[2] + take, s[3] - take
            if out:
                yield pd.DataFrame(out, columns=[*pdf.columns[: n_keys + 1], "d_day", "d_sgn", "d_lo",
                                                 "s_day", "s_sgn", "s_lo", "n"])
    return run


def greedy_counts(demand: DataFrame, supply: DataFrame, keys: list[str], tol: int, by_sign: bool) -> DataFrame:
    """Greedy on (keys, cls, date, sgn, start, n) counts; ``start`` places are taken already.

    Returns runs, each with a number of its own: n demand places from d_lo of (d_date, d_sgn) meet n supply places from s_lo of (s_date, s_sgn).
    """
    cols = [*keys, "cls", "t", "kind", "day", "sgn", "start", "n"]
    day = F.unix_date("date")
    events = (demand.withColumn("kind", F.lit(1)).withColumn("t", day)
              .unionByName(supply.withColumn("kind", F.lit(0)).withColumn("t", day - tol))
              .withColumn("day", day))
    # drop entries without a partner in reach before any row goes to Python
    near = Window.partitionBy(*keys, "cls").orderBy("day").rangeBetween(-tol, tol)
    supplies, demands = F.count_if(F.col("kind") == 0).over(near), F.count_if(F.col("kind") == 1).over(near)
    events = events.withColumn("others", F.when(F.col("kind") == 1, supplies).otherwise(demands)).filter("others > 0")
    # a demand and a supply that reach only each other are settled here; only contested ones go to Python
    mate = F.max(F.when(F.col("kind") == 0, F.struct("day", "sgn", "start", "n", "others"))).over(near)
    mate_d = F.max(F.when(F.col("kind") == 1, F.col("others"))).over(near)
    events = stored(events.withColumn("mate", mate).withColumn("alone", (F.col("others") == 1) & F.when(
        F.col("kind") == 1, F.col("mate.others") == 1).otherwise(mate_d == 1)))
    settled = events.filter("alone and kind = 1 and least(n, mate.n) > 0").select(
        *keys, "cls", F.col("day").alias("d_day"), F.col("sgn").alias("d_sgn"), (F.col("start") + 1).alias("d_lo"), F.col("mate.day").alias("s_day"),
        F.col("mate.sgn").alias("s_sgn"), (F.col("mate.start") + 1).alias("s_lo"), F.least("n", "mate.n").alias("n"))
    events = events.filter("not alone").select(*cols)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields[: len(keys) + 1])
    runs = (events.repartition(*keys, "cls").sortWithinPartitions(*keys, "cls", "t", "kind", "day", "sgn")
            .mapInPandas(_fold(len(keys), tol, by_sign),
                         schema + ", d_day int, d_sgn int, d_lo long, s_day int, s_sgn int, s_lo long, n long"))
    # runs are far fewer than rows and read several times: written once
    return stored(runs.unionByName(settled).withColumn("run", F.monotonically_increasing_id()).withColumn("d_date", F.date_from_unix_date("d_day"))
                  .withColumn("s_date", F.date_from_unix_date("s_day")).drop("d_day", "s_day"))


def _day_counts(ledger: DataFrame, bank: DataFrame, keys: list[str]) -> DataFrame:
    both = (ledger.select(*keys, "cents", "date", F.lit(1).alias("l"), F.lit(0).alias("b"))
            .unionByName(bank.select(*keys, "cents", "date", F.lit(0).alias("l"), F.lit(1).alias("b"))))
    days = both.dropna(subset=[*keys, "cents", "date"]).groupBy(*keys, "cents", "date").agg(F.sum("l").alias("nl"), F.sum("b").alias("nb"))
    return stored(days.withColumn("m", F.least("nl", "nb")))


def _exact_runs(days: DataFrame, keys: list[str]) -> DataFrame:
    one = F.lit(1).cast("bigint")
    return days.filter("m > 0").select(
        *keys, "cents", F.lit(0).alias("step"), F.col("date").alias("l_date"), one.alias("l_lo"),
        F.col("date").alias("b_date"), one.alias("b_lo"), F.col("m").alias("n"))


def _tolerant_runs(days: DataFrame, keys: list[str], tol: int) -> DataFrame:
    """Runs on what the exact step leaves of every day: places from m + 1 on."""
    rest = days.withColumn("sgn", F.lit(0)).withColumn("cls", F.col("cents"))

    def left(count: str) -> DataFrame:
        return rest.filter(F.col(count) > F.col("m")).select(
            *keys, "cls", "date", "sgn", F.col("m").alias("start"), (F.col(count) - F.col("m")).alias("n"))

    return greedy_counts(left("nl"), left("nb"), keys, tol, by_sign=False).select(
        *keys, F.col("cls").alias("cents"), F.lit(1).alias("step"), F.col("d_date").alias("l_date"),
        F.col("d_lo").alias("l_lo"), F.col("s_date").alias("b_date"), F.col("s_lo").alias("b_lo"), "n")


def one_to_one_runs(ledger: DataFrame, bank: DataFrame, keys: list[str], tol: int | None = 3, exact: bool = True) -> DataFrame:
    """J1 + J2 + J3 on counts: runs with their first match number. ``tol`` None leaves the tolerant step out.

    Columns: keys, cents, step (0 exact, 1 tolerant), l_date, l_lo, b_date, b_lo, n, first_no.
    """
    days = _day_counts(ledger, bank, keys)
    if not exact:
        days = days.withColumn("m", F.lit(0).cast("bigint"))
    steps = ([_exact_runs(days, keys)] if exact else []) + ([_tolerant_runs(days, keys, tol)] if tol is not None else [])
    runs = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
    runs = runs.withColumn("__a", F.struct("step", "l_date")).withColumn("__b", F.struct("cents", "l_lo"))
    return stored(exclusive_prefix(runs, keys, ["__a", "__b"], "n", "first_no").drop("__a", "__b"))


def _whole(cls: list[str]) -> Column:
    """Has account, date and amount, without which a row cannot match."""
    whole = F.lit(True)
    for c in cls:
        whole = whole & F.col(c).isNotNull()
    return whole


def _placed(rows: DataFrame, lists: DataFrame, cls: list[str], how: str) -> DataFrame:
    """Rows with their place ``__k`` in their class, and what ``lists`` has for the class; both come with one join."""
    rows = rows.withColumn("__blk", id_block())
    local = Window.partitionBy(*cls, "__blk").orderBy("row_id")
    rows = rows.withColumn("__rn", F.row_number().over(local))
    blocks = rows.groupBy(*cls, "__blk").agg(F.count("*").alias("__n"))
    blocks = join_sorted(exclusive_prefix(blocks, cls, ["__blk"], "__n", "__off").drop("__n"), lists, cls, how)
    return join_sorted(rows, blocks, [*cls, "__blk"]).withColumn("__k", F.col("__rn") + F.col("__off"))


def tag_side(df: DataFrame, runs: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Hand the runs back to the rows of one side ('l' or 'b'): adds step, match_no, match_date (the other
    side's date); null where unmatched. A day of one amount has at most 2*tol+2 runs."""
    other = "b" if side == "l" else "l"
    cls = [*keys, "cents", "date"]
    lists = runs.groupBy(*keys, "cents", F.col(f"{side}_date").alias("date")).agg(F.collect_list(F.struct(
        F.col(f"{side}_lo").alias("lo"), "n", "step", "first_no", F.col(f"{other}_date").alias("partner"))).alias("__runs"))
    whole, k = _whole(cls), F.col("__k")
    hit = F.get(F.filter("__runs", lambda r: (r["lo"] <= k) & (k < r["lo"] + r["n"])), F.lit(0))
    out = _placed(df.filter(whole), lists, cls, "left").withColumn("__hit", hit).select(
        *df.columns, F.col("__hit.step").alias("step"), (F.col("__hit.first_no") + k - F.col("__hit.lo")).alias("match_no"),
        F.col("__hit.partner").alias("match_date"))
    # rows that cannot match stay
    return out.unionByName(df.filter(~whole), allowMissingColumns=True)


def match_one_to_one(ledger: DataFrame, bank: DataFrame, keys: list[str], tol: int = 3,
                     exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """J1 + J2 + J3: both sides with ``match_id`` ``S-<n>`` (null where unmatched)."""
    ledger, bank = stored(ledger), stored(bank)
    runs = one_to_one_runs(ledger, bank, keys, tol, exact)
    return tuple(with_match_id(tag_side(df, runs, keys, side)) for df, side in ((ledger, "l"), (bank, "b")))


def match_tolerant(ledger: DataFrame, bank: DataFrame, keys: list[str], tol: int = 3) -> DataFrame:
    """Nearest date within ``tol`` days, same cents; remaining rows of both sides."""
    lhs, rhs = match_one_to_one(ledger, bank, keys, tol, exact=False)
    return pairs(lhs, rhs, keys)


def with_match_id(df: DataFrame) -> DataFrame:
    """J3."""
    return df.withColumn("match_id", F.concat(F.lit("S-"), F.col("match_no").cast("string")))


def pairs(ledger: DataFrame, bank: DataFrame, keys: list[str]) -> DataFrame:
    """Matched rows side by side."""
    lhs = ledger.filter("match_no is not null").select(*keys, "match_no", "step", F.col("row_id").alias("ledger_id"))
    rhs = bank.filter("match_no is not null").select(*keys, "match_no", F.col("row_id").alias("bank_id"))
    return lhs.join(rhs, [*keys, "match_no"])


def split(df: DataFrame, flag: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Matched and unmatched rows of a tagged side."""
    flag = F.col("match_no").isNotNull() if flag is None else flag
    return df.filter(flag), df.filter(~flag)


def remaining(df: DataFrame, matched: DataFrame, keys: list[str], id_col: str = "row_id") -> DataFrame:
    """J4 / K5 from a table of matched ids."""
    return df.join(matched.select(*keys, F.col(id_col).alias("row_id")), [*keys, "row_id"], "left_anti")


def match_any_sign(bank: DataFrame, ledger: DataFrame, keys: list[str], tol: int = 3) -> DataFrame:
    """Each bank row takes the first ledger row within ``tol`` days of equal amount, else of opposite sign."""
    cls = [*keys, "cents", "date"]
    bank, ledger = (stored(df.select(*cls, "row_id").filter(_whole(cls))) for df in (bank, ledger))

    def counts(df: DataFrame) -> DataFrame:
        return (df.groupBy(*keys, F.abs("cents").alias("cls"), "date", F.signum("cents").cast("int").alias("sgn"))
                .agg(F.count("*").alias("n")).withColumn("start", F.lit(0).cast("bigint")))

    runs = greedy_counts(counts(bank), counts(ledger), keys, tol, by_sign=True)
    runs = runs.select(*keys, "run", (F.col("cls") * F.col("d_sgn")).alias("bank_cents"),
                       (F.col("cls") * F.col("s_sgn")).alias("ledger_cents"), F.col("d_date").alias("bank_date"),
                       F.col("s_date").alias("ledger_date"), "d_lo", "s_lo", "n")

    def expand(df: DataFrame, side: str, other: str, lo: str) -> DataFrame:
        lists = runs.groupBy(*keys, F.col(f"{side}_cents").alias("cents"), F.col(f"{side}_date").alias("date")).agg(
            F.collect_list(F.struct(F.col(lo).alias("lo"), "n", "run", F.col(f"{other}_cents").alias("o_cents"),
                                    F.col(f"{other}_date").alias("o_date"))).alias("__runs"))
        k = F.col("__k")
        hit = F.get(F.filter("__runs", lambda r: (r["lo"] <= k) & (k < r["lo"] + r["n"])), F.lit(0))
        return (_placed(df, lists, cls, "inner").withColumn("__hit", hit).filter("__hit is not null")
                .select(*keys, F.col("__hit.run").alias("run"), F.col("row_id").alias(f"{side}_id"), F.col("cents").alias(f"{side}_cents"),
                        F.col("__hit.o_cents").alias(f"{other}_cents"), F.col("date").alias(f"{side}_date"),
                        F.col("__hit.o_date").alias(f"{other}_date"), (k - F.col("__hit.lo")).alias("no")))

    lhs = expand(bank, "bank", "ledger", "d_lo")
    rhs = expand(ledger, "ledger", "bank", "s_lo").select("run", "no", "ledger_id")
    # the run and the place in it say which rows meet
    return (lhs.join(rhs, ["run", "no"]).select(*keys, "bank_cents", "ledger_cents", "bank_date", "ledger_date", "bank_id", "ledger_id")
            .withColumn("opposite_sign", F.col("bank_cents") != F.col("ledger_cents")))
