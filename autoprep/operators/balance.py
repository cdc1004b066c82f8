"""Class balancing by synthetic rows and neighbour-based cleaning. All choices come from key hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SMALL_DICTIONARY_ROWS
from ..functions.columns import col_of
from ..functions.indexing import number_rows
from ..functions.lineage import cut_lineage
from .knn import knn
from .vectors import as_array

DRAWS = 1_000_003
ENN_NEIGHBORS = 3
COPIES_PER_BLOCK = 1_000


def _class_sizes(df: DataFrame, label: str) -> dict:
    counts = df.where(col_of(label).isNotNull()).groupBy(col_of(label).alias("c")).count()
    rows = counts.limit(SMALL_DICTIONARY_ROWS + 1).collect()
    if len(rows) > SMALL_DICTIONARY_ROWS:
        raise ValueError(f"{label!r} has more than {SMALL_DICTIONARY_ROWS} classes: it is no class label")
    return {r["c"]: r["count"] for r in rows}


def _points(df: DataFrame, key: str, features: list[str], label: str) -> DataFrame:
    return df.select(col_of(key).cast("string").alias("key"), as_array(df, features).alias("x"), col_of(label).alias("label"))


def _draw(buckets: Column | int, purpose: str, seed: int) -> Column:
    n = F.lit(buckets) if isinstance(buckets, int) else buckets
    return F.pmod(F.xxhash64("key", "j", F.lit(seed), F.lit(purpose)), n.cast("bigint"))


def _interpolate(seeds: DataFrame, neighbors: DataFrame, k: int, seed: int) -> DataFrame:
    """``seeds(key, copies)`` to synthetic points between each key and drawn neighbours.

    A seed meets its neighbours once, as one array; its copies are made afterwards, in blocks that
    are dealt over all tasks. So a few seeds with very many copies are no hot keys.
    """
    around = neighbors.groupBy("key").agg(
        F.first("x").alias("x"), F.array_sort(F.collect_list(F.struct("rank", "neighbor_x"))).alias("near")
    )
    blocks = (
        seeds.where("copies > 0").join(around, "key")
        .select("key", "copies", "x", "near", F.explode(F.expr(f"sequence(0L, cast(copies - 1 as bigint), {COPIES_PER_BLOCK}L)")).alias("at"))
        .repartition("key", "at")
    )
    last = F.least(F.col("at") + COPIES_PER_BLOCK, F.col("copies")) - 1
    drawn = (
        blocks.select("key", "x", "near", F.explode(F.sequence("at", last.cast("bigint"))).alias("j"))
        .withColumn("neighbor_x", F.element_at("near", (_draw(k, "neighbor", seed) + 1).cast("int"))["neighbor_x"])
        .withColumn("step", _draw(DRAWS, "step", seed) / F.lit(float(DRAWS)))
    )
    step = F.col("step")
    return drawn.select(
        F.concat_ws("~", "key", "j").alias("key"), F.zip_with("x", "neighbor_x", lambda a, b: a + step * (b - a)).alias("x")
    )


def _even_copies(members: DataFrame, total: int, size: int, seed: int) -> DataFrame:
    """``total`` copies over ``size`` rows, the remainder to the first rows in hash order."""
    ordered = number_rows(members.select("key", F.xxhash64("key", F.lit(seed)).alias("h")), ["h", "key"], "i")
    return ordered.select("key", (F.lit(total // size) + (F.col("i") < total % size).cast("int")).alias("copies"))


def _assemble(df: DataFrame, key: str, features: list[str], label: str, synthetic: list[DataFrame]) -> DataFrame:
    types = {c: df.schema[c].dataType for c in df.columns}
    kept = df.select(*[col_of(c).cast("string").alias(c) if c == key else col_of(c).cast("double").alias(c) if c in features
                       else col_of(c) for c in df.columns]).withColumn("is_synthetic", F.lit(False))
    place = {c: i for i, c in enumerate(features)}
    for s in synthetic:
        rows = s.select(*[
            F.col("key").alias(c) if c == key else F.col("x")[place[c]].alias(c) if c in place
            else F.col("label").alias(c) if c == label else F.lit(None).cast(types[c]).alias(c) for c in df.columns
        ], F.lit(True).alias("is_synthetic"))
        kept = kept.unionByName(rows)
    return kept


def smote(df: DataFrame, key: str, features: list[str], label: str, k: int = 5, seed: int = 42, exact: bool = True) -> DataFrame:
    """Grow every class to the size of the largest with points between same-class neighbours.

    The key becomes text; synthetic rows are marked and keep only features and label. ``exact=False``
    draws from the neighbours of the approximate search.
    """
    sizes = _class_sizes(df, label)
    largest = max(sizes.values())
    points, made = _points(df, key, features, label), []
    for c, n in sorted(sizes.items()):
        if n < largest:
            if n < 2:
                raise ValueError(f"class {c!r} has one row: no neighbour to interpolate with")
            members = points.where(F.col("label") == F.lit(c))
            near = min(k, n - 1)
            neighbors = knn(members, members, "key", "x", near, vectors=True, exact=exact)
            seeds = _even_copies(members, largest - n, n, seed)
            made.append(_interpolate(seeds, neighbors, near, seed).withColumn("label", F.lit(c)))
    return _assemble(df, key, features, label, made)


def adasyn(df: DataFrame, key: str, features: list[str], label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Like SMOTE, but rows with more other-class neighbours get more copies."""
    sizes = _class_sizes(df, label)
    largest = max(sizes.values())
    points, made = _points(df, key, features, label), []
    for c, n in sorted(sizes.items()):
        if n < largest:
            if n < 2:
                raise ValueError(f"class {c!r} has one row: no neighbour to interpolate with")
            members = points.where(F.col("label") == F.lit(c))
            around = knn(members, points, "key", "x", k, tag="label")
            hardness = cut_lineage(around.groupBy("key").agg(
                (F.count_if(F.col("neighbor_tag") != F.lit(c)) / F.lit(float(k))).alias("share")
            ))
            total = hardness.agg(F.sum("share")).first()[0]
            if not total:
                raise ValueError(f"no neighbour of class {c!r} belongs to another class: use smote")
            seeds = hardness.select("key", F.bround(F.col("share") / F.lit(total) * F.lit(float(largest - n)), 0).cast("bigint").alias("copies"))
            near = min(k, n - 1)
            neighbors = knn(members, members, "key", "x", near, vectors=True)
            made.append(_interpolate(seeds, neighbors, near, seed).withColumn("label", F.lit(c)))
    return _assemble(df, key, features, label, made)


def enn_keep(df: DataFrame, key: str, features, label: str, k: int = ENN_NEIGHBORS) -> DataFrame:
    """Rows whose ``k`` nearest neighbours all share their class."""
    near = knn(df, df, key, features, k, tag=label)
    bad = near.where(F.col("tag") != F.col("neighbor_tag")).select("key").distinct()
    return df.join(bad, col_of(key) == F.col("key"), "left_anti") if key != "key" else df.join(bad, "key", "left_anti")


def tomek_links(df: DataFrame, key: str, features, label: str) -> DataFrame:
    """``(a, b)`` with a < b: mutual nearest neighbours of different classes."""
    one = knn(df, df, key, features, 1, tag=label).where(F.col("tag") != F.col("neighbor_tag")).select("key", "neighbor")
    # Both ends of a pair meet on the pair itself, so a row that is the nearest of many is no hot key.
    pair = one.select(F.least("key", "neighbor").alias("a"), F.greatest("key", "neighbor").alias("b"))
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b")


def drop_tomek(df: DataFrame, key: str, features, label: str) -> DataFrame:
    links = tomek_links(df, key, features, label)
    gone = links.select(F.explode(F.array("a", "b")).alias("__gone")).distinct()
    return df.join(gone, col_of(key) == F.col("__gone"), "left_anti")


def smote_enn(df: DataFrame, key, features, label, k: int = 5, seed: int = 42, enn_k: int = ENN_NEIGHBORS) -> DataFrame:
    grown = cut_lineage(smote(df, key, features, label, k, seed))
    return enn_keep(grown, key, features, label, enn_k)


def smote_tomek(df: DataFrame, key, features, label, k: int = 5, seed: int = 42) -> DataFrame:
    grown = cut_lineage(smote(df, key, features, label, k, seed))
    return drop_tomek(grown, key, features, label)


SAMPLERS = {"smote": smote, "adasyn": adasyn, "smote_enn": smote_enn, "smote_tomek": smote_tomek}


def balance(df: DataFrame, key: str, features: list[str], label: str, strategy: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Apply a strategy; ``none`` and ``class_weight`` leave the rows as they are."""
    if strategy in ("none", "class_weight"):
        return df
    if strategy not in SAMPLERS:
        raise ValueError(f"unknown balancing strategy: {strategy!r}")
    return SAMPLERS[strategy](df, key, features, label, k=k, seed=seed)
