"""Many-to-one matching: a bank row against the signed sum of 2 to 4 ledger rows.

The pool of a bank row is the free ledger rows within ``tol`` days, in (date, cents, row_id) order; with a ``cap``, the first
so many of them. The bound is the caller's: None searches whole windows, and results say where a bound cut a pool
(``pool_cut``). All bank rows of one day share a pool, so pools are built per (keys, bank date): an equi join, no
range join, with a cap never more than (2*tol+1)*cap rows in a group.
"""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallybook.operators.ordering import id_block, ordinal
from tallybook.session import cut_lineage, stored

# fixed values: largest subset, allowed difference in cents
MAX_SIZE, SLACK = 4, 1
SLICE_ROWS = 20_000
WIDE = 24          # pools above this size are searched row by row
NARROW = 12        # pools up to this size are tested by all their subsets when pruning
BLOCK = 256        # bank rows of a day that meet an unbounded window in one task
PAIRS = 1_000      # windows up to this size are tested by their pair sums when pruning


@cache
def _subsets(n: int, size: int) -> np.ndarray:
    """Index subsets in lexicographic order, one column per position."""
    return np.array(list(combinations(range(n), size)), dtype=np.int64).reshape(-1, size).T


def _subset_sums(values: np.ndarray, size: int) -> np.ndarray:
    """|sum| of every subset; values is (..., n)."""
    index = _subsets(values.shape[-1], size)
    total = values[..., index[0]]
    for part in index[1:]:
        total = total + values[..., part]
    return np.abs(total)


class _Places:
    """A pool's values in its order, and the places of each value: a pair is found by looking up what is missing, in memory of the pool's size."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.order = np.argsort(values, kind="stable")
        self.sorted = values[self.order]

    def pair(self, targets: np.ndarray, after: int = -1) -> list[int] | None:
        """First places i < j behind ``after`` whose values sum to a target."""
        own = self.values[after + 1:]
        places = np.arange(after + 1, len(self.values))
        first = len(self.values)
        for t in targets:
            missing = t - own[: first - after - 1]
            last = np.searchsorted(self.sorted, missing, "right") - 1
            hit = (self.sorted[last] == missing) & (self.order[last] > places[: len(missing)]) & (last >= 0)
            if hit.any():
                first = min(first, after + 1 + int(hit.argmax()))
        if first == len(self.values):
            return None
        second = len(self.values)
        for t in targets:
            left, right = np.searchsorted(self.sorted, t - self.values[first], "left"), np.searchsorted(self.sorted, t - self.values[first], "right")
            at = left + np.searchsorted(self.order[left:right], first, "right")
            if at < right:
                second = min(second, int(self.order[at]))
        return [first, second]

    def first(self, targets: np.ndarray, size: int, after: int = -1) -> list[int] | None:
        """Places of the lexicographically first subset of that size whose sum is a target."""
        if size == 2:
            return self.pair(targets, after) if len(self.values) - after > 2 else None
        for i in range(after + 1, len(self.values) - size + 1):
            rest = self.first(targets - self.values[i], size - 1, i)
            if rest:
                return [i, *rest]
        return None


def _search(values: np.ndarray, want: int, max_size: int) -> list[int] | None:
    """First subset of a wide pool: smallest size, then the pool's order."""
    if len(values) <= PAIRS and not _may_fit(values, want, max_size):
        return None
    places = _Places(values)
    targets = np.unique([s * want + d for s in (1, -1) for d in range(-SLACK, SLACK + 1) if want + s * d >= 0])
    hits = (places.first(targets, size) for size in range(2, min(max_size, len(values)) + 1))
    return next((h for h in hits if h), None)


def _may_fit(values: np.ndarray, want: int, max_size: int) -> bool:
    """Whether some sum of up to max_size values, repeats allowed, meets the amount: false only if no subset does."""
    pairs = np.unique(values[:, None] + values[None])

    def near(sums: np.ndarray, targets: np.ndarray) -> bool:
        return bool((np.searchsorted(sums, targets - SLACK, "left") < np.searchsorted(sums, targets + SLACK, "right")).any())
    both = np.array([want, -want])
    if near(pairs, both):
        return True
    if max_size >= 3 and near(pairs, (both[:, None] - values[None]).ravel()):
        return True
    return max_size >= 4 and any(near(pairs, w - pairs) for w in both)


def _may_fit_each(pools: pd.Series, target: pd.Series, max_size: int) -> np.ndarray:
    """``_may_fit`` for many pools; those of up to NARROW rows are tested by all their subsets, equal sizes at once."""
    fits, sizes = np.ones(len(pools), dtype=bool), pools.map(len).to_numpy()
    for n in np.unique(sizes[sizes <= NARROW]):
        at = np.flatnonzero(sizes == n)
        for chunk in np.array_split(at, max(1, len(at) // 512)):
            values, want = np.stack([np.asarray(pools.iloc[i], dtype=np.int64) for i in chunk]), np.abs(target.to_numpy()[chunk])[:, None]
            fits[chunk] = np.any([(np.abs(_subset_sums(values, size) - want) <= SLACK).any(axis=1) for size in range(2, min(max_size, n) + 1)], axis=0)
    for i in np.flatnonzero((sizes > NARROW) & (sizes <= PAIRS)):
        fits[i] = _may_fit(np.asarray(pools.iloc[i], dtype=np.int64), abs(target.iloc[i]), max_size)
    return fits


# ---- pools ---------------------------------------------------------------------------------------

def day_pools(bank: DataFrame, ledger: DataFrame, keys: list[str], tol: int, cap: int | None) -> DataFrame:
    """(keys, date) of the bank with ``pool``: the (first ``cap``) ledger rows (date, cents, row_id) in reach, and ``pool_cut``."""
    rows = ledger.select(*keys, "date", "cents", "row_id")
    if cap is not None:             # one more tells whether there are more
        head = Window.partitionBy(*keys, "date").orderBy("cents", "row_id")
        rows = rows.withColumn("__rn", F.row_number().over(head)).filter(F.col("__rn") <= cap + 1)
    days = rows.groupBy(*keys, "date").agg(F.collect_list(F.struct("date", "cents", "row_id")).alias("rows"))
    reach = F.explode(F.sequence(F.date_sub("date", tol), F.date_add("date", tol)))
    wanted = bank.select(*keys, "date").distinct()
    pools = (days.select(*keys, reach.alias("target"), "rows").withColumnRenamed("target", "date")
             .join(wanted, [*keys, "date"], "left_semi")
             .groupBy(*keys, "date").agg(F.array_sort(F.flatten(F.collect_list("rows"))).alias("pool")))
    if cap is None:
        return pools.withColumn("pool_cut", F.lit(False))
    return pools.withColumn("pool_cut", F.size("pool") > cap).withColumn("pool", F.slice("pool", 1, cap))


def combo_candidates(bank: DataFrame, ledger: DataFrame, keys: list[str], cap: int | None, tol: int = 3) -> DataFrame:
    """The pool of every bank row, one row per candidate, with its place and whether the pool was cut."""
    pools = day_pools(bank, ledger, keys, tol, cap)
    return (bank.select(*keys, "date", F.col("row_id").alias("bank_id")).join(pools, [*keys, "date"])
            .select(*keys, "bank_id", "pool_cut", F.posexplode("pool").alias("place", "c"))
            .select(*keys, "bank_id", (F.col("place") + 1).alias("place"), F.col("c.row_id").alias("ledger_id"), "pool_cut"))


def _first_subset(max_size: int):
    @F.pandas_udf("array<int>")
    def first_subset(pools: pd.Series, target: pd.Series) -> pd.Series:
        result = [None] * len(pools)
        sizes = pools.map(len).to_numpy()
        want = np.abs(target.to_numpy())
        for n in np.unique(sizes[sizes >= 2]):
            at = np.flatnonzero(sizes == n)
            if n > WIDE:            # too many subsets to hold for several rows at once
                for i in at:
                    values = np.asarray(pools.iloc[i], dtype=np.int64)
                    result[i] = _search(values, int(want[i]), max_size)
                continue
            for chunk in np.array_split(at, max(1, len(at) // 512)):
                values = np.stack([np.asarray(pools.iloc[i], dtype=np.int64) for i in chunk])
                open_ = np.arange(len(chunk))
                for size in range(2, min(max_size, n) + 1):
                    hit = np.abs(_subset_sums(values[open_], size) - want[chunk[open_], None]) <= SLACK
                    found = hit.any(axis=1)
                    first = hit.argmax(axis=1)
                    for o, f in zip(open_[found], first[found]):
                        result[chunk[o]] = _subsets(int(n), size)[:, f].tolist()
                    open_ = open_[~found]
                    if not len(open_):
                        break
        return pd.Series(result)
    return first_subset


def combo_enumerate(bank: DataFrame, ledger: DataFrame, keys: list[str], cap: int | None, tol: int = 3,
                    max_size: int = MAX_SIZE) -> DataFrame:
    """Per bank row the first subset of its static pool that meets it: smallest size, then pool order.

    With a ``cap`` pools are short and go along with the bank rows. Without one, so do the windows of up to WIDE ledger rows, many of them in one call;
    a longer window's ledger rows and a block of the bank rows of its day meet in a task, which looks sums up in memory of the window's size.
    """
    pools = day_pools(bank, ledger, keys, tol, WIDE if cap is None else cap)
    if cap is not None:
        return _enumerate_pools(bank, pools, keys, max_size)
    pools = stored(pools.withColumn("pool", F.when(~F.col("pool_cut"), F.col("pool"))))
    wide = bank.join(pools.filter("pool_cut").select(*keys, "date"), [*keys, "date"], "left_semi")
    return _enumerate_pools(bank, pools.filter("not pool_cut"), keys, max_size).unionByName(_enumerate_windows(wide, ledger, keys, tol, max_size))


def _enumerate_pools(bank: DataFrame, pools: DataFrame, keys: list[str], max_size: int) -> DataFrame:
    cents = F.transform("pool", lambda c: c["cents"])
    found = (bank.join(pools, [*keys, "date"]).filter(F.size("pool") >= 2)
             .withColumn("__at", _first_subset(max_size)(cents, F.col("cents"))).filter("__at is not null"))
    return found.select(*keys, F.col("row_id").alias("bank_id"), F.size("__at").alias("size"),
                        F.transform("__at", lambda i: F.get("pool", i)["row_id"]).alias("members"), "pool_cut")


def _enumerate_windows(bank: DataFrame, ledger: DataFrame, keys: list[str], tol: int, max_size: int) -> DataFrame:
    day = [*keys, "date"]
    blocks = bank.groupBy(*day).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    asks = bank.join(blocks, day).select(*day, F.pmod(F.xxhash64("row_id"), F.col("blocks")).alias("block"), "cents", "row_id")
    reach = F.explode(F.sequence(F.date_sub("date", tol), F.date_add("date", tol)))
    near = ledger.select(*keys, reach.alias("target"), "date", "cents", "row_id").withColumnRenamed("date", "on").withColumnRenamed("target", "date")
    near = near.join(blocks, day).select(*day, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "on", "cents", "row_id")
    out = T.StructType([bank.schema[k] for k in keys]).add("bank_id", "long").add("size", "integer").add("members", T.ArrayType(T.LongType()))
    schema = to_arrow_schema(out)

    def solve(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        rows = []
        if asked.num_rows and held.num_rows >= 2:
            held = held.sort_by([("on", "ascending"), ("cents", "ascending"), ("row_id", "ascending")])
            values, ids = held.column("cents").to_numpy(), held.column("row_id").to_numpy()
            known: dict[int, list[int] | None] = {}
            for cents, row_id in zip(asked.column("cents").to_pylist(), asked.column("row_id").to_pylist(), strict=True):
                want = abs(cents)
                if want not in known:
                    known[want] = _search(values, want, max_size)
                if known[want]:
                    rows.append((row_id, ids[known[want]].tolist()))
        own = [pa.array([k.as_py()] * len(rows), f.type) for k, f in zip(key[: len(keys)], schema, strict=False)]
        return pa.table([*own, pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=out.names).cast(schema)
    group = [*day, "block"]
    return asks.groupBy(*group).cogroup(near.groupBy(*group)).applyInArrow(solve, out).withColumn("pool_cut", F.lit(False))


# ---- greedy assignment ---------------------------------------------------------------------------

def _possible(bank: DataFrame, ledger: DataFrame, keys: list[str], tol: int, max_size: int) -> DataFrame:
    """Bank rows that could match: sums of the whole window's pairs allow it, or the window is too large to say. Leaves results as they are."""
    @F.pandas_udf("boolean")
    def may_fit(pools: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series(_may_fit_each(pools, target, max_size), dtype=bool)
    pools = day_pools(bank, ledger, keys, tol, PAIRS + 1).filter(F.size("pool") >= 2)
    cents = F.transform("pool", lambda c: c["cents"])
    return bank.join(pools, [*keys, "date"]).filter(may_fit(cents, F.col("cents"))).select(*bank.columns)


def _slices(bank: DataFrame, keys: list[str], tol: int, slice_rows: int) -> DataFrame:
    """(keys, date, island, slice): islands share no ledger row; long islands are cut into slices of days."""
    by_date = Window.partitionBy(*keys).orderBy("date")
    days = bank.groupBy(*keys, "date").agg(F.count("*").alias("n"))
    gap = F.datediff("date", F.lag("date").over(by_date)) > 2 * tol
    days = days.withColumn("__gap", F.coalesce(gap, F.lit(False)).cast("int"))
    days = days.withColumn("island", F.sum("__gap").over(by_date.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*keys, "island").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return (days.withColumn("slice", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / slice_rows).cast("int"))
            .select(*keys, "date", "island", "slice", "n"))


def _assign(n_keys: int, tol: int, cap: int | None, max_size: int):
    """Streams events sorted by (group, time, ledger first).

    State: the free ledger rows of one date window, the first ``cap`` of them as the pool, the others in a queue.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, pool, queue, sums = None, [], deque(), {}
        for pdf in batches:
            out = []
            names = pdf.columns[: n_keys + 2]
            for row in pdf.itertuples(index=False, name=None):
                key = row[: n_keys + 2]
                kind, day, cents, row_id = row[n_keys + 3:]
                if key != group:
                    group, pool, queue, sums = key, [], deque(), {}
                if kind == 0:
                    queue.append((day, cents, row_id))
                    continue
                gone = 0
                while gone < len(pool) and pool[gone][0] < day - tol:
                    gone += 1
                if gone:
                    pool, sums = pool[gone:], {}
                while queue and queue[0][0] < day - tol:
                    queue.popleft()
                while queue and (cap is None or len(pool) < cap):
                    pool.append(queue.popleft())
                    sums = {}
                values = np.array([p[1] for p in pool], dtype=np.int64)
                members = _search(values, abs(cents), max_size) if len(values) > WIDE else None
                for size in range(2, min(max_size, len(values)) + 1 if len(values) <= WIDE else 0):
                    if size not in sums:
                        sums[size] = _subset_sums(values, size)
                    hit = np.abs(sums[size] - abs(cents)) <= SLACK
                    if hit.any():
                        members = _subsets(len(values), size)[:, hit.argmax()].tolist()
                        break
                if members:
                    for m in members:
                        out.append((*key, row_id, day, len(members), pool[m][2], pool[m][0], bool(queue)))
                    pool = [p for i, p in enumerate(pool) if i not in members]
                    sums = {}
            if out:
                yield pd.DataFrame(out, columns=[*names, "bank_id", "bank_day", "size", "ledger_id", "ledger_day", "pool_cut"])
    return run


def _within_quota(ledger: DataFrame, days: DataFrame, keys: list[str], tol: int, cap: int, max_size: int) -> DataFrame:
    """Ledger rows that can reach a pool at all.

    A day seen by B bank rows gives up at most ``max_size`` * B rows, so its rows beyond place cap + max_size * B are
    never among the first ``cap`` free ones. Only days longer than that are numbered.
    """
    reach = F.explode(F.sequence(F.date_sub("date", tol), F.date_add("date", tol)))
    quota = (days.select(*keys, reach.alias("d"), "n").groupBy(*keys, F.col("d").alias("date"))
             .agg((F.sum("n") * max_size + cap).alias("__quota")))
    near = stored(ledger.join(quota, [*keys, "date"]))
    long_days = near.groupBy(*keys, "date", "__quota").agg(F.count("*").alias("__size")).filter("__size > __quota")
    if long_days.isEmpty():
        return near.select(*ledger.columns)
    day = [*keys, "date"]
    cut = ordinal(near.join(long_days.select(*day), day, "left_semi").withColumn("__blk", id_block()), day, ["cents", "__blk"], ["row_id"], "__k")
    return (near.join(long_days.select(*day), day, "left_anti").select(*ledger.columns)
            .unionByName(cut.filter(F.col("__k") <= F.col("__quota")).select(*ledger.columns)))


def combo_assign(bank: DataFrame, ledger: DataFrame, keys: list[str], cap: int | None, tol: int = 3,
                 max_size: int = MAX_SIZE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Bank rows in (date, cents, row_id) order each take the first subset of their free pool.

    Rows that can never match are pruned; what is left splits into islands of days that share no ledger row.
    A hot island is cut into slices that run in parallel as if nothing had been taken before; slices whose
    left neighbour took rows they had counted on run again until nothing changes. The fixed point is the
    sequential result (slice s is right after round s at the latest).

    Returns (keys, bank_id, bank_date, size, ledger_id, ledger_date, pool_cut), one row per member.
    """
    group = [*keys, "island", "slice"]
    bank = bank.select(*keys, "date", "cents", "row_id")
    ledger = ledger.select(*keys, "date", "cents", "row_id")
    bank = cut_lineage(_possible(bank, ledger, keys, tol, max_size))
    days = _slices(bank, keys, tol, slice_rows)
    days = cut_lineage(days)
    bank_in = bank.join(days.drop("n"), [*keys, "date"])
    reach = F.explode(F.sequence(F.date_sub("date", tol), F.date_add("date", tol)))
    ledger_days = days.select(*group, reach.alias("target")).withColumnRenamed("target", "date").distinct()
    near = ledger if cap is None else _within_quota(ledger, days, keys, tol, cap, max_size)
    ledger_in = near.join(ledger_days, [*keys, "date"])
    events = [*group, "t", "kind", "day", "cents", "row_id"]

    def solve(bank_rows: DataFrame, ledger_rows: DataFrame) -> DataFrame:
        day = F.unix_date("date")
        both = (bank_rows.withColumn("kind", F.lit(1)).withColumn("t", day)
                .unionByName(ledger_rows.withColumn("kind", F.lit(0)).withColumn("t", day - tol))
                .withColumn("day", day).select(*events))
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema.fields[: len(group)])
        return (both.repartition(*group).sortWithinPartitions(*group, "t", "kind", "day", "cents", "row_id")
                .mapInPandas(_assign(len(keys), tol, cap, max_size), types + ", bank_id long, bank_day int, "
                             "size int, ledger_id long, ledger_day int, pool_cut boolean"))

    result = solve(bank_in, ledger_in)
    if not days.filter("slice > 0").isEmpty():
        result = _settle(cut_lineage(result), bank_in, ledger_in, days, keys, tol, solve)
    return cut_lineage(result.select(
        *keys, "bank_id", F.date_from_unix_date("bank_day").alias("bank_date"), "size", "ledger_id",
        F.date_from_unix_date("ledger_day").alias("ledger_date"), "pool_cut"))


def _settle(result: DataFrame, bank_in: DataFrame, ledger_in: DataFrame, days: DataFrame, keys: list[str], tol: int,
            solve) -> DataFrame:
    group = [*keys, "island", "slice"]
    # a slice may be followed by a numbering gap (one heavy day), so the next slice is looked up
    starts = days.groupBy(*group).agg(F.min(F.unix_date("date")).alias("start"))
    order = Window.partitionBy(*keys, "island").orderBy("slice")
    after = cut_lineage(starts.withColumn("next", F.lead("slice").over(order))
                        .withColumn("next_start", F.lead("start").over(order)).drop("start").filter("next is not null"))
    taken = [*group, "ledger_id", "ledger_day"]
    entry = result.select(*taken).limit(0)
    while True:
        seen = (result.select(*taken).unionByName(entry).join(after, group)
                .filter(F.col("ledger_day") >= F.col("next_start") - tol)
                .drop("slice", "next_start").withColumnRenamed("next", "slice").select(*taken).distinct())
        seen = cut_lineage(seen)
        changed = cut_lineage(seen.subtract(entry).unionByName(entry.subtract(seen)).select(*group).distinct())
        if changed.isEmpty():
            return result
        used = seen.select(*group, F.col("ledger_id").alias("row_id"))
        again = solve(bank_in.join(changed, group, "left_semi"),
                      ledger_in.join(changed, group, "left_semi").join(used, [*group, "row_id"], "left_anti"))
        result = cut_lineage(result.join(changed, group, "left_anti").unionByName(again))
        entry = seen


def number_combos(combos: DataFrame, bank: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``group_id`` C-<n>, n from 0 in bank order, and the group's first date."""
    heads = (combos.groupBy(*keys, "bank_id").agg(F.least(F.first("bank_date"), F.min("ledger_date")).alias("cluster_date"))
             .join(bank.select(*keys, "date", "cents", F.col("row_id").alias("bank_id")), [*keys, "bank_id"]))
    heads = ordinal(heads, keys, ["date"], ["cents", "bank_id"], "__no")
    heads = heads.select(*keys, "bank_id", "cluster_date",
                         F.concat(F.lit("C-"), (F.col("__no") - 1).cast("string")).alias("group_id"))
    return combos.join(heads, [*keys, "bank_id"])
