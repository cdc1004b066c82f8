"""Sums of one large array per task, without sending all of them to one place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK, SALTS = 1 << 14, 32


def summed_array(rows: DataFrame, length: int, per_task: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of the float64 arrays of fixed length that ``per_task`` makes of each task's batches.

    The input is read by at most a few tasks per core, so what is sent follows the cluster, not the
    input. Blocks of the arrays are summed by salted groups, then by block; only the sum, whose
    length the caller fixes, reaches the driver.
    """
    schema = "block int, salt int, part binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.asarray(per_task(batches), np.float64)
        salt = TaskContext.get().partitionId() % SALTS
        for b in range(0, length, BLOCK):
            part = whole[b : b + BLOCK].tobytes()
            yield pa.record_batch([pa.array([b // BLOCK], pa.int32()), pa.array([salt], pa.int32()), pa.array([part])], ["block", "salt", "part"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py(), np.float64) for p in group.column("part"))
        return pa.table({"block": group.column("block").slice(0, 1), "salt": group.column("salt").slice(0, 1), "part": [total.tobytes()]})

    parts = rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)
    parts = parts.groupBy("block", "salt").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    out = np.zeros(length)
    for r in parts.collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["part"], np.float64)
    return out
