"""Numbers and texts packed into binary columns, and rows of a sorted partition taken group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import sliced


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers as planes of equal bytes, which shrink when they are shuffled."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def numbers(packed: list[bytes], kind: str) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(kind).ravel() for b in packed]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows with the same first column, which have to follow one another."""
    now, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for at, end in zip([0, *edges], [*edges, len(keys)]):
            if at < end:
                if held and keys[at] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = int(keys[at])
                held.append(batch.slice(at, end - at))
    if held:
        yield now, pa.Table.from_batches(held)


def squeezed(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, text)`` with the texts as compressed bytes, for rows that are shuffled; a null stays null."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [None if x is None else x.encode() for x in batch.column(2).to_pylist()]
            packs = [None if x is None else len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in texts]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packs, pa.binary())], ["doc_id", "version", "text"])

    return docs.select("doc_id", "version", "text").mapInArrow(pack, "doc_id bigint, version bigint, text binary")


def unsqueezed(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b""
