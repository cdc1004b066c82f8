"""DBSCAN in any number of dimensions: an exact range join of blocks under triangle bounds.

Distinct vectors are placed by their nearest pivot, and neighbouring cells share a block of bounded size.
Two blocks meet once if the pivots' distance lets vectors of any two of their cells come within ``eps``,
and only such cells are compared in the meeting, which sends on counts and links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of
from ..functions.components import smallest_reachable
from ..functions.indexing import number_rows
from ..functions.lineage import cut_lineage
from ..operators.knn import CELL_ROWS, MAX_PIVOTS, ROUNDING, TILE_CELLS, _block_rows, _blocks, _distances, _nearest_pivot, _sampled
from ..operators.vectors import as_array

# Links a meeting holds before it folds them into roots.
OPEN_LINKS = 1 << 21


def _close(a: np.ndarray, b: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within ``eps``, in strips of at most about ``TILE_CELLS`` distances; doubtful ones are computed exactly."""
    bn, strip = (b * b).sum(1), max(1, TILE_CELLS // max(1, len(b)))
    for at in range(0, len(a), strip):
        part = a[at : at + strip]
        an = (part * part).sum(1)
        rough = an[:, None] + bn[None, :] - 2 * part @ b.T
        i, j = np.nonzero(rough <= eps * eps + 4 * ROUNDING * (an[:, None] + bn[None, :]))
        near = np.sqrt(((part[i] - b[j]) ** 2).sum(1)) <= eps
        yield i[near] + at, j[near]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches over the links."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (jump := root[root]).tolist() != root.tolist():
            root = jump
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _joined(root: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Roots after further links between roots."""
    a, b = (np.concatenate(x) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
    return _roots(len(root), a, b)[root]


def _wanted(pivots: np.ndarray, extents, eps: float) -> np.ndarray:
    """By two cells: whether vectors of both may lie within ``eps``."""
    near, far = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in extents:
        near[r["cell"]], far[r["cell"]] = r["near"], r["far"]
    apart = _distances(pivots, pivots)
    slack = eps + 1e-6 * (1 + float(apart.max()) + float(far.max()))
    gap = np.maximum(apart - far[:, None] - far[None, :], np.maximum(near[:, None] - apart - far[None, :], near[None, :] - apart - far[:, None]))
    return gap <= slack


def _meetings(wanted: np.ndarray, blocks: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs of blocks, each once, that hold cells which may lie within reach of each other."""
    known = np.array(sorted(blocks))
    ranges, at = np.unique(np.array([blocks[c] for c in known]), axis=0, return_inverse=True)
    member = np.zeros((len(known), len(ranges)), np.float32)
    member[np.arange(len(known)), at.ravel()] = 1
    i, j = np.nonzero(member.T @ wanted[np.ix_(known, known)].astype(np.float32) @ member)
    span = [range(int(first), int(first + parts)) for first, parts in ranges]
    return [(a, b) for u, v in zip(i, j) if u <= v for a in span[u] for b in span[v] if a <= b]


def _members(cell: np.ndarray) -> dict[int, np.ndarray]:
    order = cell.argsort(kind="stable")
    known, starts = np.unique(cell[order], return_index=True)
    return dict(zip(known.tolist(), np.split(order, starts[1:])))


def _pairs(a: np.ndarray, a_cell: np.ndarray, b: np.ndarray, b_cell: np.ndarray, same: bool, wanted: np.ndarray, eps: float):
    """``(rows of a, rows of b)`` within ``eps``, of cells that may be; of one block with itself both orders are given."""
    other = _members(b_cell)
    for c, rows in _members(a_cell).items():
        for e, others in other.items():
            if wanted[c, e] and (not same or c <= e):
                for i, j in _close(a[rows], b[others], eps):
                    yield rows[i], others[j]
                    if same and c < e:
                        yield others[j], rows[i]


def dbscan_blocks(df: DataFrame, key: str, features, eps: float, min_samples: int) -> DataFrame:
    """``(key, cluster)``: clusters count from 0 by smallest core key, noise is -1.

    A border point within reach of several clusters joins the first. Copies are one place with a
    count. Rows without a vector, or with a missing component, are noise. Comparisons between cells that
    bounds cannot tell apart grow with the square of their rows.
    """
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps must be positive and min_samples at least 1")
    key_type = df.schema[key].dataType.simpleString()
    points = df.select(col_of(key).alias("key"), as_array(df, features).alias("x"))
    whole = F.coalesce(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)), F.lit(False))
    places = cut_lineage(points.where(whole).groupBy("x").agg(F.min("key").alias("place"), F.count(F.lit(1)).alias("m")))
    size = places.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    if not size["n"]:
        return points.select("key", F.lit(-1).cast("bigint").alias("cluster"))
    rows = _block_rows(size["n"], size["d"], df.sparkSession.sparkContext.defaultParallelism)
    pivots = _sampled(places, size["d"], min(MAX_PIVOTS, math.ceil(size["n"] / min(rows / 4, CELL_ROWS))))
    placed = cut_lineage(places.withColumn("at", _nearest_pivot(pivots)("x")).select("place", "x", "m", "at.cell", "at.dist"))
    extents = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far")).collect()
    blocks = _blocks(pivots, extents, rows)
    wanted = _wanted(pivots, extents, float(eps))
    spark = df.sparkSession
    held = spark.createDataFrame([(c, first, n) for c, (first, n) in blocks.items()], "cell int, first int, parts int")
    part = F.pmod(F.xxhash64("place"), F.col("parts").cast("bigint")).cast("int")
    placed = placed.drop("dist").join(F.broadcast(held), "cell").withColumn("block", F.col("first") + part).drop("first", "parts")
    meetings = F.broadcast(spark.createDataFrame(_meetings(wanted, blocks), "a int, b int"))
    d, reach = size["d"], float(eps)

    def met(table: DataFrame, more: str):
        here = table.join(meetings, F.col("block") == F.col("a")).select("a", "b", "place", "x", "cell", more)
        there = table.join(meetings, (F.col("block") == F.col("b")) & (F.col("a") < F.col("b")))
        there = there.select(*[F.col(c).alias(c) for c in ("a", "b", "place", "x", "cell", more)])
        return here.groupBy("a", "b").cogroup(there.groupBy("a", "b"))

    def sides(left: pa.Table, right: pa.Table, more: str):
        """Vectors, cells and the further column of both sides; a block that meets itself is both."""
        same = not right.num_rows
        read = [(t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d), t["cell"].to_numpy(), t[more].to_numpy())
                for t in ([left] if same else [left, right])]
        return same, read[0], read[-1]

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        same, (a, a_cell, am), (b, b_cell, bm) = sides(left, right, "m")
        an, bn = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for i, j in _pairs(a, a_cell, b, b_cell, same, wanted, reach):
            np.add.at(an, i, bm[j])
            if not same:
                np.add.at(bn, j, am[i])
        tables = [(left, an)] if same else [(left, an), (right, bn)]
        return pa.concat_tables([pa.table([t["place"], pa.array(n)], names=["place", "near"]) for t, n in tables])

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        same, (a, a_cell, a_core), (b, b_cell, b_core) = sides(left, right, "core")
        shift = 0 if same else len(a)
        core = a_core if same else np.concatenate([a_core, b_core])
        root, links, open_, edges = np.arange(len(core)), [], 0, []
        for i, j in _pairs(a, a_cell, b, b_cell, same, wanted, reach):
            j = j + shift
            both = core[i] & core[j]
            u, v = root[i[both]], root[j[both]]
            links.append((u[u != v], v[u != v]))
            open_ += len(links[-1][0])
            # A border point has fewer than ``min_samples`` neighbours, so these stay few.
            edges += [np.stack([p[e], q[e]], 1) for p, q in ((i, j), (j, i)) for e in [~core[p] & core[q]]]
            if open_ > OPEN_LINKS:
                root, links, open_ = _joined(root, links), [], 0
        root = _joined(root, links)
        names = pa.chunked_array([*left["place"].chunks, *([] if same else right["place"].chunks)], left["place"].type)
        linked = np.flatnonzero(root != np.arange(len(core)))
        # A border point knows one core point of each cluster it touches here.
        touch = np.concatenate([np.zeros((0, 2), np.int64), *edges])
        touch = np.unique(np.stack([touch[:, 0], root[touch[:, 1]]], 1), axis=0)
        p, q = np.concatenate([linked, touch[:, 0]]), np.concatenate([root[linked], touch[:, 1]])
        border = pa.array(np.arange(len(p)) >= len(linked))
        return pa.table([names.take(pa.array(p)), names.take(pa.array(q)), border], names=["a", "b", "border"])

    placed = cut_lineage(placed)
    near = met(placed, "m").applyInArrow(count, f"place {key_type}, near bigint").groupBy("place").agg(F.sum("near").alias("near"))
    known = cut_lineage(placed.join(near, "place").withColumn("core", F.col("near") >= min_samples))
    links = cut_lineage(met(known, "core").applyInArrow(link, f"a {key_type}, b {key_type}, border boolean"))
    found = cut_lineage(smallest_reachable(links.where("not border").select("a", "b")))
    cores = known.where("core").join(found, known["place"] == found["node"], "left").select("place", F.coalesce("root", "place").alias("root"))
    cores = cut_lineage(cores)
    touched = links.where("border").join(cores, links["b"] == cores["place"]).groupBy("a").agg(F.min("root").alias("root"))
    rooted = cores.unionByName(touched.select(F.col("a").alias("place"), "root"))
    numbered = number_rows(cores.select("root").distinct(), ["root"], "cluster")
    named = rooted.join(numbered, "root").join(places.select("place", "x"), "place").select("x", "cluster")
    return points.join(named, "x", "left").select("key", F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"))
