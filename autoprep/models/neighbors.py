"""Neighbour-based models: nearest-neighbour classification and local outlier factor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut_lineage
from ..functions.lookup import lookup
from ..functions.quantiles import exact_quantiles
from ..operators.knn import knn

# Guard against division by zero in the density, and the automatic outlier limit.
DENSITY_GUARD = 1e-10
AUTO_LIMIT = 1.5


def knn_classify(
    queries: DataFrame, base: DataFrame, key: str, features, label: str, k: int = 5, weights: str = "uniform",
    exclude_self: bool = False, exact: bool = True,
) -> DataFrame:
    """``(key, prediction)`` by neighbour vote; ``distance`` weighs 1/d and lets exact hits decide alone.

    ``exact=False`` asks the approximate search.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weighting: {weights!r}")
    return vote(labelled_neighbors(queries, base, key, features, label, k, exclude_self, exact), k, weights)


def labelled_neighbors(queries: DataFrame, base: DataFrame, key: str, features, label: str, k: int, exclude_self: bool = False, exact: bool = True) -> DataFrame:
    """The ``k`` nearest rows with their labels; queries need none."""
    if label not in queries.columns:
        queries = queries.withColumn(label, F.lit(None).cast(base.schema[label].dataType))
    return knn(queries, base, key, features, k, tag=label, exclude_self=exclude_self, exact=exact)


def vote(near: DataFrame, k: int, weights: str = "uniform") -> DataFrame:
    """``(key, prediction)`` of the ``k`` first of the neighbours found."""
    votes = near.where(F.col("rank") <= k).groupBy("key", F.col("neighbor_tag").alias("c")).agg(
        F.count_if(F.col("distance") == 0).alias("hits"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("distance") > 0, 1 / F.col("distance"))).alias("inverse"),
    )
    if weights == "uniform":
        strength = F.struct(-F.col("n"), F.col("c"))
    else:
        strength = F.struct(-F.col("hits"), -F.coalesce("inverse", F.lit(0.0)), F.col("c"))
    return votes.groupBy("key").agg(F.min_by("c", strength).alias("prediction"))


def lof(df: DataFrame, key: str, features, k: int = 20, contamination: float | str = "auto", exact: bool = True) -> DataFrame:
    """``(key, lof, is_outlier)``: density of the neighbours over the own density.

    ``exact=False`` takes the neighbours of the approximate search.
    """
    near = cut_lineage(knn(df, df, key, features, k, exact=exact).select("key", "neighbor", "distance"))
    # A row can be the neighbour of very many others, so lookups by neighbour know each row's fame.
    fame = near.groupBy(F.col("neighbor").alias("key")).agg(F.count(F.lit(1)).alias("fame"))

    def of_neighbor(rows: DataFrame, facts: DataFrame, value: str) -> DataFrame:
        table = facts.join(fame, "key", "left").select(
            F.col("key").alias("neighbor"), value, F.coalesce("fame", F.lit(0)).alias("fame")
        )
        return lookup(rows, ["neighbor"], table, [value], weight="fame")

    reach = near.groupBy("key").agg(F.max("distance").alias("k_distance"))
    reached = of_neighbor(near, reach, "k_distance").withColumn("r", F.greatest("distance", "k_distance"))
    density = cut_lineage(reached.groupBy("key").agg((1 / (F.avg("r") + F.lit(DENSITY_GUARD))).alias("density")))
    around = of_neighbor(near.select("key", "neighbor"), density, "density")
    scores = around.groupBy("key").agg(F.avg("density").alias("around")).join(density, "key").select(
        "key", (F.col("around") / F.col("density")).alias("lof")
    )
    if contamination == "auto":
        limit = AUTO_LIMIT
    else:
        scores = cut_lineage(scores)
        limit = exact_quantiles(scores, ["lof"], [1 - float(contamination)])["lof"][0]
    return scores.withColumn("is_outlier", F.col("lof") > F.lit(limit))
