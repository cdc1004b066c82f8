"""Words of many texts at once: folded bytes, offsets and 64-bit hashes as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
_K = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def fold_table(letters_only: bool = False) -> bytes:
    """Byte map: A-Z to lower case and white space to 0x20; with ``letters_only`` ASCII punctuation too."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        if b in (9, 10, 11, 12, 13, 32) or (letters_only and not c.isalnum()):
            table[b] = 32
        elif "A" <= c <= "Z":
            table[b] = b + 32
    return bytes(table)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of MurmurHash3)."""
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence of hashes: ``a`` stands for what came before, ``b`` for the next."""
    return mix(a * _K + b)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without 0x20."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != 32
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    length = (ends - starts).astype(np.int64)
    out = mix(length.astype(np.uint64) + np.uint64(1))
    todo = np.arange(len(starts))
    at = starts.astype(np.int64)
    while len(todo):
        left = length[todo]
        part = eight[at]
        short = left < 8
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
        out[todo] = chain(out[todo], np.where(short, part & keep, part))
        more = left > 8
        todo, at = todo[more], at[more] + 8
        length[todo] -= 8
    return out


def pieces(texts: list[bytes | None], size: int = CHUNK_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of texts of about ``size`` bytes; a longer text is cut at white space into several pieces.

    The texts have to be folded. A text's pieces follow one another; null counts as empty.
    """
    which: list[int] = []
    parts: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        text, at = text or b"", 0
        while True:
            end = len(text)
            if end - at > size:
                end = text.find(b" ", at + size)
                end = len(text) if end < 0 else end
            which.append(i)
            parts.append(text[at:end] if at or end < len(text) else text)
            held += end - at
            at = end
            if held >= size:
                yield which, parts
                which, parts, held = [], [], 0
            if at >= len(text):
                break
    if parts:
        yield which, parts


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def hashed_words(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of folded texts: the text number of each word, its hash, and its length in bytes."""
    for which, parts in pieces(texts):
        data = np.frombuffer(b" ".join(parts), np.uint8)
        starts, ends = word_spans(data)
        bound = np.cumsum([len(p) + 1 for p in parts])
        owner = np.asarray(which)[np.searchsorted(bound, starts, "right")]
        yield owner, hash_spans(data, starts, ends), ends - starts
