"""DBSCAN on a grid, exact, without comparing all points of a crowded cell; beyond three dimensions by blocks.

Cells have a diagonal of ``eps``, so all points of one cell are neighbours and a cell with
``min_samples`` points is all core. What remains — how many points lie near a point of a sparse
cell, and whether two cells hold core points within ``eps`` — is decided on bounding boxes of
ever smaller sub-cells: boxes wholly inside ``eps`` count at once, boxes wholly outside drop out,
and only the undecided ones split. Copies collapse to one location with a count first.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of
from ..functions.indexing import number_rows
from ..functions.lineage import cut_lineage
from ..functions.lookup import lookup
from ..operators.vectors import as_array
from .dbscan_blocks import dbscan_blocks

MAX_DIMENSIONS = 3
# Undecided boxes compare their locations directly once that takes at most this many comparisons
# in all, or at the last depth, where a box is a 4096th of a cell wide.
DIRECT_COMPARISONS = 50_000_000
MAX_DEPTH = 12
MAX_ROUNDS = 200


class _Grid:
    def __init__(self, d: int, eps: float):
        self.d, self.eps2 = d, eps * eps
        self.side = eps / math.sqrt(d)
        reach = math.ceil(math.sqrt(d))
        self.offsets = list(product(range(-reach, reach + 1), repeat=d))
        self.xs = [f"x{i}" for i in range(d)]
        self.cs = [f"c{i}" for i in range(d)]

    def cell(self, depth: int) -> list[Column]:
        return [F.floor(F.col(x) * F.lit(2.0 ** depth) / F.lit(self.side)) for x in self.xs]

    def boxes(self, places: DataFrame, depth: int, prefix: str) -> DataFrame:
        """Bounding box and number of points per occupied sub-cell."""
        keys = [k.alias(f"{prefix}k{i}") for i, k in enumerate(self.cell(depth))]
        sides = []
        for i, x in enumerate(self.xs):
            sides += [F.min(x).alias(f"{prefix}lo{i}"), F.max(x).alias(f"{prefix}hi{i}")]
        return places.groupBy(*keys).agg(*sides, F.sum("m").alias(f"{prefix}m"), F.count(F.lit(1)).alias(f"{prefix}n"))

    def gap2(self, a: str, b: str) -> Column:
        total = F.lit(0.0)
        for i in range(self.d):
            g = F.greatest(F.lit(0.0), F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}"), F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}"))
            total = total + g * g
        return total

    def span2(self, a: str, b: str) -> Column:
        total = F.lit(0.0)
        for i in range(self.d):
            g = F.greatest(F.abs(F.col(f"{a}hi{i}") - F.col(f"{b}lo{i}")), F.abs(F.col(f"{b}hi{i}") - F.col(f"{a}lo{i}")))
            total = total + g * g
        return total

    def children(self, rows: DataFrame, prefix: str) -> DataFrame:
        """Replace each sub-cell key by the keys of its 2^d parts."""
        parts = [
            F.struct(*[(F.col(f"{prefix}k{i}") * 2 + F.lit(bit)).alias(f"n{i}") for i, bit in enumerate(bits)])
            for bits in product((0, 1), repeat=self.d)
        ]
        gone = [c for c in rows.columns if c.startswith(prefix) and (c[len(prefix):].startswith(("lo", "hi", "k")) or c in (f"{prefix}m", f"{prefix}n"))]
        out = rows.withColumn("__part", F.explode(F.array(*parts))).drop(*gone)
        return out.select(*[col_of(c) for c in out.columns if c != "__part"],
                          *[F.col("__part")[f"n{i}"].alias(f"{prefix}k{i}") for i in range(self.d)])

    def keys(self, prefix: str) -> list[str]:
        return [f"{prefix}k{i}" for i in range(self.d)]


def dbscan(df: DataFrame, key: str, features, eps: float, min_samples: int) -> DataFrame:
    """``(key, cluster)``: clusters count from 0 by smallest member key, noise is -1.

    A border point within reach of several clusters joins the one with the smallest cell.
    """
    sample = df.select(F.size(as_array(df, features)).alias("d")).where("d > 0").first()
    if sample is None:
        return df.select(col_of(key).alias("key"), F.lit(-1).cast("bigint").alias("cluster"))
    d = sample["d"]
    if d > MAX_DIMENSIONS:  # a grid has too many neighbouring cells
        return dbscan_blocks(df, key, features, eps, min_samples)
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps must be positive and min_samples at least 1")
    grid = _Grid(d, float(eps))
    vector = as_array(df, features)
    points = df.select(col_of(key).alias("key"), *[(vector[i] + F.lit(0.0)).alias(x) for i, x in enumerate(grid.xs)])
    points = points.na.drop(subset=grid.xs)
    places = points.groupBy(*grid.xs).agg(F.count(F.lit(1)).alias("m"))
    places = cut_lineage(places.select("*", *[c.alias(n) for n, c in zip(grid.cs, grid.cell(0))]))
    cells = places.groupBy(*grid.cs).agg(F.sum("m").alias("in_cell"), F.count(F.lit(1)).alias("places"))
    placed = lookup(places, grid.cs, cells, ["in_cell"], weight="places")
    crowded = F.col("in_cell") >= min_samples
    dense = placed.where(crowded).drop("in_cell")
    sparse = cut_lineage(placed.where(~crowded).drop("in_cell"))

    near = _points_near(grid, sparse, places)
    core_sparse = near.where(F.col("near") >= min_samples).drop("near")
    core = cut_lineage(dense.unionByName(sparse.join(core_sparse, grid.xs, "left_semi")))
    labels = _components(grid, core)

    border = sparse.join(core_sparse, grid.xs, "left_anti")
    reached = _points_near(grid, border, core, labels)
    in_core = lookup(core, grid.cs, labels.join(cells, grid.cs), ["root"], weight="places").select(*grid.xs, "root")
    rooted = in_core.unionByName(reached).join(places.select(*grid.xs, "m"), grid.xs)
    assigned = cut_lineage(lookup(points, grid.xs, rooted, ["root"], weight="m").select("key", "root"))
    found = assigned.where("root is not null").groupBy("root").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    numbered = number_rows(found, ["first"], "cluster")
    named = lookup(assigned, ["root"], numbered, ["cluster"], weight="n")
    return named.select("key", F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"))


def _points_near(grid: _Grid, asked: DataFrame, places: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Points within ``eps`` of each asked location (``near``), or with labels the smallest root
    among the core cells that hold one (``root``)."""
    offsets = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(off)]) for off in grid.offsets])
    state = asked.select(*grid.xs, *grid.cs, F.explode(offsets).alias("o")).select(
        *grid.xs, *[(F.col(c) + F.col("o")[f"o{i}"]).alias(f"bk{i}") for i, c in enumerate(grid.cs)]
    )
    state = state.select("*", *[F.col(x).alias(f"alo{i}") for i, x in enumerate(grid.xs)], *[F.col(x).alias(f"ahi{i}") for i, x in enumerate(grid.xs)],
                         *[F.col(f"bk{i}").alias(f"cell{i}") for i in range(grid.d)])
    cell_names = [f"cell{i}" for i in range(grid.d)]
    keep = [*grid.xs, *cell_names]
    hits = []
    for depth in range(MAX_DEPTH + 1):
        met = state.join(grid.boxes(places, depth, "b"), grid.keys("b"))
        met = cut_lineage(met.where(grid.gap2("a", "b") <= grid.eps2).withColumn("all_in", grid.span2("a", "b") <= grid.eps2))
        hits.append(met.where("all_in").select(*keep, F.col("bm").alias("near")))
        open_rows = met.where(~F.col("all_in")).drop("all_in")
        work = open_rows.agg(F.sum("bn")).first()[0]
        if not work:
            break
        if work <= DIRECT_COMPARISONS or depth == MAX_DEPTH:
            leaf = places.select(*[k.alias(f"bk{i}") for i, k in enumerate(grid.cell(depth))],
                                 *[F.col(x).alias(f"p{i}") for i, x in enumerate(grid.xs)], "m")
            d2 = sum(((F.col(x) - F.col(f"p{i}")) * (F.col(x) - F.col(f"p{i}")) for i, x in enumerate(grid.xs)), F.lit(0.0))
            hits.append(open_rows.join(leaf, grid.keys("b")).where(d2 <= grid.eps2).select(*keep, F.col("m").alias("near")))
            break
        state = grid.children(open_rows, "b")
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    if labels is None:
        return found.groupBy(*grid.xs).agg(F.sum("near").alias("near"))
    roots = labels.select(*[F.col(c).alias(n) for c, n in zip(grid.cs, cell_names)], "root")
    # A core cell neighbours few sparse locations, so no key of this join is hot.
    return found.select(*keep).distinct().join(roots, cell_names).groupBy(*grid.xs).agg(F.min("root").alias("root"))


def _edges(grid: _Grid, core: DataFrame) -> DataFrame:
    """Pairs of neighbouring core cells with core points within ``eps``."""
    forward = [o for o in grid.offsets if o > tuple([0] * grid.d)]
    offsets = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(off)]) for off in forward])
    cells = core.select(*grid.cs).distinct()
    names = [f"u{i}" for i in range(grid.d)] + [f"v{i}" for i in range(grid.d)]
    state = cells.withColumn("o", F.explode(offsets)).select(
        *[F.col(c).alias(f"u{i}") for i, c in enumerate(grid.cs)],
        *[(F.col(c) + F.col("o")[f"o{i}"]).alias(f"v{i}") for i, c in enumerate(grid.cs)],
        *[F.col(c).alias(f"ak{i}") for i, c in enumerate(grid.cs)],
        *[(F.col(c) + F.col("o")[f"o{i}"]).alias(f"bk{i}") for i, c in enumerate(grid.cs)],
    )
    done = []
    for depth in range(MAX_DEPTH + 1):
        met = state.join(grid.boxes(core, depth, "a"), grid.keys("a")).join(grid.boxes(core, depth, "b"), grid.keys("b"))
        met = cut_lineage(met.where(grid.gap2("a", "b") <= grid.eps2).withColumn("linked", grid.span2("a", "b") <= grid.eps2))
        linked = met.where("linked").select(*names).distinct()
        done.append(linked)
        open_rows = met.where(~F.col("linked")).drop("linked").join(linked, names, "left_anti")
        work = open_rows.agg(F.sum(F.col("an") * F.col("bn"))).first()[0]
        if not work:
            break
        if work <= DIRECT_COMPARISONS or depth == MAX_DEPTH:
            spots = [
                core.select(*[k.alias(f"{p}k{i}") for i, k in enumerate(grid.cell(depth))],
                            *[F.col(x).alias(f"{p}x{i}") for i, x in enumerate(grid.xs)]) for p in ("a", "b")
            ]
            d2 = sum(((F.col(f"ax{i}") - F.col(f"bx{i}")) * (F.col(f"ax{i}") - F.col(f"bx{i}")) for i in range(grid.d)), F.lit(0.0))
            close = open_rows.select(*names, *grid.keys("a"), *grid.keys("b")).join(spots[0], grid.keys("a")).join(spots[1], grid.keys("b"))
            done.append(close.where(d2 <= grid.eps2).select(*names).distinct())
            break
        state = grid.children(grid.children(open_rows, "a"), "b")
    out = done[0]
    for e in done[1:]:
        out = out.unionByName(e)
    return out.distinct()


def _components(grid: _Grid, core: DataFrame) -> DataFrame:
    """``(cell, root)`` by smallest-label propagation with pointer jumping."""
    us, vs = [f"u{i}" for i in range(grid.d)], [f"v{i}" for i in range(grid.d)]
    one_way = _edges(grid, core)
    here, there = (F.concat_ws(",", *[F.col(c).cast("string") for c in side]) for side in (us, vs))
    ends = one_way.select(here.alias("u"), there.alias("v"))
    edges = cut_lineage(ends.select("u", "v").toDF("s", "t").unionByName(ends.select("v", "u").toDF("s", "t")))
    nodes = core.select(*grid.cs).distinct().select(*grid.cs, F.concat_ws(",", *[F.col(c).cast("string") for c in grid.cs]).alias("node"))
    labels = cut_lineage(nodes.select("node", F.col("node").alias("root")))
    for _ in range(MAX_ROUNDS):
        offered = edges.join(labels, edges["s"] == labels["node"]).groupBy(F.col("t").alias("node")).agg(F.min("root").alias("offer"))
        lower = labels.join(offered, "node", "left").select("node", "root", F.least("root", F.coalesce("offer", "root")).alias("next"))
        # The root's own label may have dropped too: follow it one step.
        fame = lower.groupBy(F.col("next").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        step = lower.select("node", F.col("next").alias("jump")).join(fame, "node").withColumnRenamed("node", "next")
        after = cut_lineage(lookup(lower, ["next"], step, ["jump"], weight="n")
                            .select("node", F.least("next", F.coalesce("jump", "next")).alias("new"), F.col("root").alias("old")))
        labels = after.select("node", F.col("new").alias("root"))
        if after.where("new <> old").isEmpty():
            break
    else:
        raise RuntimeError("clusters did not settle")
    return nodes.join(labels, "node").drop("node")
