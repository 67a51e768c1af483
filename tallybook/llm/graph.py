"""Connected components of an edge table with joins and aggregates only."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable over the undirected edges (a, b).

    Alternates two steps until nothing changes: every node points its larger neighbours at its smallest one, then its
    smaller ones. The number of rounds grows with the logarithm of the longest path. Self loops, repeated edges and
    nulls are ignored; a node without an edge is not in the result. A node with very many neighbours is
    pre-aggregated by the minimum, and its rows are dealt anew by adaptive skew joins.
    """
    e = (edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
         .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    e = cut_lineage(e)
    state = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        e = cut_lineage(small.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
                        .union(small.select(F.col("m").alias("a"), "b")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select("a", "a").distinct())
        state = now
