"""Consecutive numbers over a global order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import col_of
from .lineage import cut_lineage


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Append 0, 1, 2, … by ``order``: number inside range partitions, then add their offsets."""
    ranged = df.repartitionByRange(*[col_of(c) for c in order])
    placed = cut_lineage(ranged.withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets += [F.lit(part), F.lit(total)]
        total += sizes[part]
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    inside = Window.partitionBy("__part").orderBy(*[col_of(c) for c in order])
    start = F.create_map(*offsets)[F.col("__part")]
    return placed.withColumn(name, (F.row_number().over(inside) - 1 + start).cast("bigint")).drop("__part")
