"""Near-duplicate vectors: a range join in each block of the rotated space, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import saved
from .tiles import meeting_tiles

BLOCK_DIMS = 16
TILE_ROWS = 16_000
#: Rows of a tile compared at once: bounds the distance matrix.
STRIP = 128


def _matrix(packed: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), kind).astype(np.float64).reshape(len(packed), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def second_moment(vectors: DataFrame, dims: int, kind: str) -> np.ndarray:
    """Sum of the outer products of the unit vectors; only a dims x dims matrix reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(0).to_pylist(), kind))
                total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], ["at", "value"])

    rows = vectors.select("v").mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(dims * dims)
    for r in rows.collect():
        out[r["at"]] = r["value"]
    return out.reshape(dims, dims)


def blocks_of(moment: np.ndarray, limit: float) -> tuple[np.ndarray, list[slice], np.ndarray]:
    """Rotation, blocks of its columns, and each block's share of the squared-distance limit.

    The principal directions are dealt to the blocks in turns, so blocks carry alike variance; a
    block's budget is proportional to it (at least half an equal share). The budgets sum to the
    limit, so two vectors within the limit are within the budget of one block at least.
    """
    dims = len(moment)
    values, vectors = np.linalg.eigh(moment)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    count = max(1, dims // BLOCK_DIMS)
    dealt = [[] for _ in range(count)]
    for k in range(dims):
        turn, place = divmod(k, count)
        dealt[place if turn % 2 == 0 else count - 1 - place].append(k)
    weight = np.array([values[d].sum() for d in dealt])
    weight = np.maximum(weight, weight.sum() / count / 2) if weight.sum() > 0 else np.ones(count)
    ends = np.cumsum([len(d) for d in dealt])
    slices = [slice(e - len(d), e) for d, e in zip(dealt, ends)]
    return np.ascontiguousarray(vectors[:, sum(dealt, [])]), slices, limit * weight / weight.sum()


def linked_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links, among n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _first_block(diff: np.ndarray, rotation: np.ndarray, slices: list[slice], budget: np.ndarray) -> np.ndarray:
    """First block within its budget. Summed element by element: the same in every task."""
    turned = np.zeros_like(diff)
    for k in range(diff.shape[1]):
        turned += diff[:, k : k + 1] * rotation[k]
    first = np.full(len(diff), -1)
    for b in range(len(slices) - 1, -1, -1):
        square = np.zeros(len(diff))
        for k in range(slices[b].start, slices[b].stop):
            square += turned[:, k] * turned[:, k]
        first[square <= budget[b] * (1 + 1e-6)] = b
    return first


def near_vectors(table: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` over the links of cosine at or above the threshold.

    Vectors that are null or zero or hold null or non-finite components link with nothing, as do rows
    with a null vec_id; they stay as rows of their own. Vectors of different lengths do not link; each
    length is searched by itself. Equal vectors are joined before the search and count as links. An
    empty table gives an empty result; extra columns are ignored.
    """
    kind = "f4" if dict(table.dtypes)["embedding"] == "array<float>" else "f8"
    numbers = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), numbers.alias("embedding"))
    fine = (
        "coalesce(vec_id is not null and not exists(embedding, x -> x is null or isnan(x)"
        " or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0), false)"
    )
    good = rows.where(fine)
    both = rows.where(f"not {fine}").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    for r in good.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect():
        both = both.union(_linked(good.where(F.size("embedding") == r["n"]), kind, r["n"], threshold))
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _linked(good: DataFrame, kind: str, dims: int, threshold: float) -> DataFrame:
    """``(vec_id, n_links, component_id)`` of sound vectors of one length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if kind == "f8":  # a power of two per vector keeps the squares of huge or tiny components finite
                flat = np.ldexp(flat, -np.frexp(np.abs(flat).max(1, keepdims=True))[1])
            packed = pa.array([r.tobytes() for r in flat.astype(kind)], pa.binary())
            yield pa.record_batch([batch.column(0), packed, batch.column(2)], ["rep", "v", "copies"])

    distinct = saved(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct-vectors")
    reps = saved(distinct.select("rep", "embedding", "copies").mapInArrow(pack, "rep bigint, v binary, copies bigint"), "vectors")
    limit = 2 - 2 * threshold
    rotation, slices, budget = blocks_of(second_moment(reps, dims, kind), limit)
    found = saved(_search(reps, kind, rotation, slices, budget, threshold), "links")
    groups = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_rep = (
        distinct.select("embedding", "rep", "copies").join(links, "rep", "left")
        .join(groups, F.col("rep") == groups.node, "left")
        .select(
            "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    per_rep = saved(per_rep, "classes")
    return good.join(per_rep, "embedding").select("vec_id", "n_links", "component_id")


def _search(reps: DataFrame, kind: str, rotation: np.ndarray, slices: list[slice], budget: np.ndarray, threshold: float) -> DataFrame:
    """``(rep, links, root)``: linked rows counted per vector, and edges that connect what is linked.

    In each block a grid over its two leading directions, as wide as the block's radius, brings
    vectors within the budget into the same or neighbouring cells.
    """
    width = np.sqrt(budget) * (1 + 1e-4) + 1e-9
    around = [(0, 0), (1, -1), (1, 0), (1, 1), (0, 1)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            turned = _unit(_matrix(batch.column(1).to_pylist(), kind)) @ rotation
            ids = batch.column(0).to_numpy()
            for b, s in enumerate(slices):
                x = np.floor(turned[:, s.start] / width[b]).astype(np.int64)
                y = np.floor(turned[:, s.start + 1] / width[b]).astype(np.int64) if s.stop - s.start > 1 else np.zeros_like(x)
                for n, (dx, dy) in enumerate(around):
                    cell = ((b << 24) + x + dx + (1 << 23) << 25) + y + dy + (1 << 24)
                    yield pa.record_batch([ids, cell, np.full(len(ids), n == 0)], ["rep", "cell", "home"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        block = int(group["cell"].iat[0] >> 49)
        across = group["tile_a"].iat[0] != group["tile_b"].iat[0]
        group = group.sort_values(["tile", "rep"], kind="stable")
        ids, copies, home = group["rep"].to_numpy(), group["copies"].to_numpy(), group["home"].to_numpy()
        raw = _matrix(group["v"].tolist(), kind)
        norm = np.sqrt((raw * raw).sum(1))
        unit = raw / norm[:, None]
        turned = (unit @ rotation[:, slices[block]]).astype(np.float32)
        square = (turned * turned).sum(1)
        split = int((group["tile"] == group["tile_a"].iat[0]).sum()) if across else len(ids)
        links, ends = np.zeros(len(ids), np.int64), [[], []]
        for at in range(0, split, STRIP):
            i, other = slice(at, min(at + STRIP, split)), split if across else at
            gap = turned[i] @ turned[other:].T
            gap *= -2
            gap += square[i, None]
            gap += square[None, other:]
            a, b = np.nonzero(gap <= budget[block] * (1 + 1e-4) + 1e-6)
            a, b = a + at, b + other
            met = (ids[a] != ids[b]) & (home[a] | home[b])
            if not across:
                met &= a < b
            a, b = a[met], b[met]
            for k in range(0, len(a), 1 << 14):
                p, q = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                near = (raw[p] * raw[q]).sum(1) / (norm[p] * norm[q]) >= threshold
                p, q = p[near], q[near]
                own = _first_block(unit[p] - unit[q], rotation, slices, budget) == block
                p, q = p[own], q[own]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                ends[0].append(p), ends[1].append(q)
        p, q = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in ends)
        root = linked_labels(len(ids), p, q)
        some = links > 0
        return pd.DataFrame({"rep": ids[some], "links": links[some], "root": ids[root[some]]})

    cells = saved(reps.select("rep", "v").mapInArrow(place, "rep bigint, cell bigint, home boolean"), "cells")
    met = meeting_tiles(cells, "cell", "rep", TILE_ROWS).join(reps, "rep")
    return met.groupBy("cell", "tile_a", "tile_b").applyInPandas(meet, "rep bigint, links bigint, root bigint")
