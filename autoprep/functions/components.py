"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node that each end of the edges ``(a, b)`` reaches.

    Every round turns each node's edges towards its smallest neighbour, first those to larger nodes,
    then the others, so the rounds follow the logarithm of the longest path. Minima are aggregated
    before they are shuffled; no node's edges are held together.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before or not state[0]:
            ends = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut_lineage(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
                          .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
