"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """Map every node of the edges ``(a, b)`` to the smallest node it reaches: ``(node, component)``.

    Each round replaces the edges by edges towards the smallest known neighbour, so the number of
    rounds grows with the logarithm of the longest path. A node with very many edges is no single
    group: its minimum is aggregated map-side and joined back, and the join's large partitions can
    be split. Edges with a null end or equal ends are ignored; no edges give no rows.
    """
    low_high = (F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = edges.where("a is not null and b is not null and a <> b")
    now = saved(edges.select(*low_high).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = saved(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        lower = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(moved.union(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(now, least, large, lower)
        now = after
