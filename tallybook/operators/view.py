"""Unified timeline of ledger and bank rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions import words as W
from tallybook.operators.ordering import id_block, join_whole, ordinal
from tallybook.session import stored

VIEW = ["row_id", "date", "cents", "description", "source", "status", "group_id", "color_code", "cluster_date"]


def build_view(ledger: DataFrame, bank: DataFrame, combos: DataFrame, keys: list[str]) -> DataFrame:
    """Tagged ledger and bank rows plus numbered combos -> timeline rows with their cluster date."""
    members = combos.select(*keys, F.col("ledger_id").alias("row_id"), F.col("group_id").alias("combo"),
                            F.col("cluster_date").alias("combo_date"))
    heads = combos.select(*keys, F.col("bank_id").alias("row_id"), F.col("group_id").alias("combo"),
                          F.col("cluster_date").alias("combo_date")).distinct()

    def side(df: DataFrame, combo: DataFrame, source: str, alone: str, name: str) -> DataFrame:
        single, grouped = F.col("match_id").isNotNull(), F.col("combo").isNotNull()
        return df.join(combo, [*keys, "row_id"], "left").select(
            *keys, "row_id", "date", "cents", "description", F.lit(source).alias("source"),
            F.when(single, W.MATCHED).when(grouped, W.MATCHED_COMBO).otherwise(alone).alias("status"),
            F.coalesce("match_id", "combo", F.lit("-1")).alias("group_id"),
            F.when(single | grouped, f"matched_{name}").otherwise(f"unmatched_{name}").alias("color_code"),
            F.when(single, F.least("date", "match_date")).when(grouped, F.col("combo_date"))
            .otherwise(F.col("date")).alias("cluster_date"))

    return (side(ledger, members, W.LEDGER_SRC, W.LEDGER_ONLY, "ledger")
            .unionByName(side(bank, heads, W.BANK_SRC, W.BANK_ONLY, "bank")))


def with_cluster_date(view: DataFrame, keys: list[str]) -> DataFrame:
    """First date of the group; groups have at most a handful of rows, rows without a group are spread by their id. The view is gone through once."""
    alone = F.col("group_id") == "-1"
    group = Window.partitionBy(*keys, "group_id", "__alone")
    return (view.drop("cluster_date").withColumn("__alone", F.when(alone, F.col("row_id")))
            .withColumn("cluster_date", F.when(alone, F.col("date")).otherwise(F.min("date").over(group))).drop("__alone"))


def _ranked(view: DataFrame) -> DataFrame:
    return view.withColumn("source_rank", F.when(F.col("source") == W.LEDGER_SRC, 0).otherwise(1))


def sort_view(view: DataFrame, keys: list[str]) -> DataFrame:
    """``pos`` in (cluster_date, group_id, source, row_id) order inside the account; write with orderBy(keys, pos).

    Rows without a date come last; rows without an account are one account.
    """
    alone = F.col("group_id") == "-1"
    view = (_ranked(view).withColumn("__head", F.left("group_id", F.lit(6)))
            .withColumn("__blk", F.struct(F.when(alone, F.col("source_rank")).otherwise(0).alias("a"),
                                          F.when(alone, id_block()).otherwise(0).alias("b"))))
    return (ordinal(view, keys, ["cluster_date", "__head", "__blk"], ["group_id", "source_rank", "row_id"], "pos")
            .drop("__head", "__blk"))


def with_group_edges(view: DataFrame, keys: list[str]) -> DataFrame:
    """First / last row of a group, and the parity of the group among the visible ones in order of appearance.

    Needs ``pos``. Rows of a group stand together, so the edges are the group's smallest and largest pos.
    """
    view = stored(view)
    alone = F.col("group_id") == "-1"
    groups = view.groupBy(*keys, "group_id").agg(F.min("pos").alias("__lo"), F.max("pos").alias("__hi"))
    groups = ordinal(groups.withColumn("__blk", id_block("__lo")), keys, ["__blk"], ["__lo"], "__no").drop("__blk")
    # one account's ungrouped rows all join one row: join the real groups, look the odd one up by account
    none = groups.filter(alone).select(*keys, F.col("__no").alias("__none"))
    real = groups.filter(~alone)
    rows = join_whole(view.filter(~alone), real, [*keys, "group_id"]).select(
        *view.columns, (F.col("pos") == F.col("__lo")).alias("is_first"), (F.col("pos") == F.col("__hi")).alias("is_last"),
        ((F.col("__no") - 1) % 2 == 0).alias("is_even_group"))
    loose = join_whole(view.filter(alone), none, keys).select(
        *view.columns, F.lit(False).alias("is_first"), F.lit(False).alias("is_last"),
        ((F.col("__none") - 1) % 2 == 0).alias("is_even_group"))
    return rows.unionByName(loose)


def top_discrepancies(view: DataFrame, keys: list[str], n: int = 50) -> DataFrame:
    """The first ``n`` unmatched rows per status in date order, with how many there are in all."""
    loose = view.filter(F.col("status").isin(W.BANK_ONLY, W.LEDGER_ONLY))
    w = Window.partitionBy(*keys, "status").orderBy(F.col("date").asc_nulls_last(), "cents", "row_id")
    top = loose.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    counts = loose.groupBy(*keys, "status").agg(F.count("*").alias("total"))
    return join_whole(top, counts, [*keys, "status"])
