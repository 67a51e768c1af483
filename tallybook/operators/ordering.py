"""Order-dependent building blocks that hold when one key owns a third of the rows.

A window over a whole account or a whole file would put a hot one into a single task. The helpers
here work in two steps instead: a window inside a bounded block (a page, a day, a range of row ids)
and a prefix over one pre-aggregated row per block. Blocks keep the order, so results are the plain
window's results.

Nulls in keys and sort columns are values like any other: rows without an account form a group, rows without a
date come last. The input is written once to the shared folder, as rows and sums both read it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.session import stored

BLOCK_BITS = 20      # rows of one id block: a task sorts them; smaller blocks leave each class of rows about as many sums as rows
STRETCH_BITS = 10    # blocks of one stretch
_LAST = 1 << 62      # stretch of a block without a number


def id_block(row_id: str = "row_id", bits: int = BLOCK_BITS) -> Column:
    """Order-preserving block of a unique integer id: holds at most 2**bits rows."""
    return F.shiftright(F.col(row_id).cast("bigint"), bits)


def _whole(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each column as a non-null pair (is null, value): equal nulls are equal, and come last."""
    pairs = {c: F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")) for c in cols}
    return df.select(*[pairs[c].alias(c) if c in pairs else F.col(c) for c in df.columns])


def _plain(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c)["v"].alias(c) if c in cols else F.col(c) for c in df.columns])


def join_whole(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null."""
    return _plain(_whole(left, keys).join(_whole(right, keys), keys, how), keys)


def join_sorted(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with sums whose number grows with the rows, which are dealt by the keys already. They are not sent to the driver as a small table: Spark goes by the size of the files they
    are made from, and what is written once (`stored`) can be many times its files."""
    return left.join(right.hint("merge"), keys, how)


def exclusive_prefix(counts: DataFrame, part: list[str], levels: list[str], n: str, out: str) -> DataFrame:
    """Sum of ``n`` over all earlier rows of ``part`` in the order of ``levels``.

    One row per (part, levels) is expected. Each level is summed and prefixed on its own, so no window
    sees more than the distinct values of one level below one parent.
    """
    keys = part + levels
    return _plain(_prefix(_whole(counts, keys), part, levels, n, out), keys)


def _prefix(counts: DataFrame, part: list[str], levels: list[str], n: str, out: str) -> DataFrame:
    if len(levels) > 1:
        counts = stored(counts)
    finest = Window.partitionBy(*(part + levels[:-1])).orderBy(levels[-1])
    earlier = (Window.unboundedPreceding, -1)
    result = counts.withColumn("__pre", F.coalesce(F.sum(n).over(finest.rowsBetween(*earlier)), F.lit(0)))
    parts = ["__pre"]
    for i, level in enumerate(levels[:-1]):
        keys = part + levels[: i + 1]
        w = Window.partitionBy(*(part + levels[:i])).orderBy(level).rowsBetween(*earlier)
        step = (counts.groupBy(*keys).agg(F.sum(n).alias("__t"))
                .select(*keys, F.coalesce(F.sum("__t").over(w), F.lit(0)).alias(f"__pre{i}")))
        result = join_sorted(result, step, keys)
        parts.append(f"__pre{i}")
    total_col = F.lit(0).cast("bigint")
    for name in parts:
        total_col = total_col + F.col(name)
    return result.withColumn(out, total_col.cast("bigint")).drop(*parts)


def ordinal(df: DataFrame, part: list[str], levels: list[str], order: list, out: str, written: bool = False) -> DataFrame:
    """1-based position inside ``part``: row_number() without a window over the whole part.

    ``levels`` are order-preserving columns, coarse to fine; ``order`` sorts inside the finest level. ``written``: the input is a table already.
    """
    keys = part + levels
    df = _whole(df if written else stored(df), keys)
    order = [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]
    local = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    offsets = _prefix(counts, part, levels, "__n", "__off").drop("__n")
    numbered = (join_sorted(local, offsets, keys)
                .withColumn(out, (F.col("__rn") + F.col("__off")).cast("bigint")).drop("__rn", "__off"))
    return _plain(numbered, keys).select(*[c for c in df.columns if c != out], out)


def _carry_in(ends: DataFrame, part: list[str], block: str, names: list[str]) -> DataFrame:
    """Per block, the last non-null block value before it: first inside a stretch of blocks, then over stretches."""
    ends = ends.withColumn("__stretch", F.coalesce(F.shiftright(F.col(block)["v"].cast("bigint"), STRETCH_BITS), F.lit(_LAST)))
    inside = Window.partitionBy(*part, "__stretch").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*part).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = ends.groupBy(*part, "__stretch").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(block))).alias(n) for n in names])
    whole = whole.select(*part, "__stretch", *[F.last(n, ignorenulls=True).over(before).alias(f"__far_{n}") for n in names])
    near = ends.select(*part, block, "__stretch", *[F.last(n, ignorenulls=True).over(inside).alias(f"__near_{n}") for n in names])
    return near.join(whole, [*part, "__stretch"]).select(
        *part, block, *[F.coalesce(f"__near_{n}", f"__far_{n}").alias(f"__in_{n}") for n in names])


def _carried(df: DataFrame, part: list[str], block: str, order: list[str], values: dict[str, Column], local) -> DataFrame:
    names, keys = list(values), [*part, block]
    out = _whole(stored(df.select("*", *[v.alias(f"__{n}") for n, v in values.items()])), keys)
    ends = out.groupBy(*part, block).agg(*[
        F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.struct(*order))).alias(n) for n in names])
    out = out.select("*", *[local(F.col(f"__{n}")).alias(f"__loc_{n}") for n in names])
    out = _plain(out.join(_carry_in(ends, part, block, names), keys), keys)
    keep = [c for c in df.columns if c not in names]
    return out.select(*keep, *[F.coalesce(f"__loc_{n}", f"__in_{n}").alias(n) for n in names])


def carry_last(df: DataFrame, part: list[str], block: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Forward fill: last non-null value up to the row, over ``part`` in (block, order)."""
    w = Window.partitionBy(*part, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _carried(df, part, block, order, values, lambda c: F.last(c, ignorenulls=True).over(w))


def previous(df: DataFrame, part: list[str], block: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Value of the row before, over ``part`` in (block, order); values must be non-null."""
    w = Window.partitionBy(*part, block).orderBy(*order)
    return _carried(df, part, block, order, values, lambda c: F.lag(c).over(w))


def running_count(df: DataFrame, part: list[str], block: str, order: list[str], flag: Column, out: str) -> DataFrame:
    """Number of set flags up to and including the row, over ``part`` in (block, order)."""
    local = Window.partitionBy(*part, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    keys = [*part, block]
    marked = _whole(stored(df.withColumn("__f", F.when(flag, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))), keys)
    totals = marked.groupBy(*keys).agg(F.sum("__f").alias("__n"))
    totals = totals.withColumn("__stretch", F.coalesce(F.shiftright(F.col(block)["v"].cast("bigint"), STRETCH_BITS), F.lit(_LAST)))
    before = _prefix(totals, part, ["__stretch", block], "__n", "__off").select(*keys, "__off")
    counted = (marked.withColumn("__loc", F.sum("__f").over(local)).join(before, keys)
               .withColumn(out, F.col("__loc") + F.col("__off")).drop("__f", "__loc", "__off"))
    return _plain(counted, keys)


def joined_text(piece: Column, order: list[str], sep: str = " ") -> Column:
    """Aggregate: pieces in order, joined. Groups are the lines of one transaction."""
    items = F.sort_array(F.collect_list(F.when(piece.isNotNull(), F.struct(*order, piece.alias("__piece")))))
    return F.array_join(items["__piece"], sep)
