"""Let the rows of each group meet pairwise in tasks of bounded size, without listing the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def meeting_tiles(rows: DataFrame, key: str, ident: str, cap: int) -> DataFrame:
    """Add ``tile``, ``tile_a`` and ``tile_b``: rows grouped by key and both tiles are at most about ``2 * cap``.

    A group is dealt into tiles of about ``cap`` rows by a hash of ``ident``, and every tile meets
    every other one and itself exactly once. Groups of one row are left out.
    """
    sizes = saved(rows.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1"), "group-sizes")
    tiles = F.ceil(F.col("__n") / cap)
    return (
        rows.join(sizes, key)
        .withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), ident), tiles).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), (tiles - 1).cast("int"))))
        .withColumn("tile_a", F.least("tile", "__other"))
        .withColumn("tile_b", F.greatest("tile", "__other"))
        .drop("__n", "__other")
    )
