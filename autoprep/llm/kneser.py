"""Interpolated modified Kneser-Ney word model, counted in Spark, kept as sorted memory-mapped arrays."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import local_folder, new_path, saved
from .words import fold_table, hashed_words

#: Hashes of the marks for a text's start and end; a word's hash is never one of them but by a 2^-64 chance.
START, END = np.uint64(0x5354415254303031), np.uint64(0x454E443030303031)
#: Words per bucket that the numbers of buckets aim at.
BUCKET_TOKENS = 4_000_000
HOT_CONTEXTS = 4096


def _token_stream(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and hash of each token: the words of a text, then its end."""
    done = 0
    for owner, h, _ in hashed_words(texts):
        # A text that goes on in the next group gets its end there.
        last = int(owner[-1]) if len(owner) else done - 1
        ends = np.arange(done, last)
        done = max(done, last)
        yield _with_ends(owner, h, ends)
    ends = np.arange(done, len(texts))
    yield _with_ends(np.zeros(0, np.int64), np.zeros(0, np.uint64), ends)


def _with_ends(owner: np.ndarray, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    who = np.concatenate([owner, ends])
    what = np.concatenate([h, np.full(len(ends), END, np.uint64)])
    order = np.argsort(who, kind="stable")
    return who[order].astype(np.int64), what[order]


def _with_contexts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text number, context (the word before, or the start) and token."""
    text, word = -1, START
    for owner, h in _token_stream(texts):
        if not len(owner):
            continue
        before = np.concatenate([[word], h[:-1]])
        first = np.concatenate([[owner[0] != text], owner[1:] != owner[:-1]])
        before = np.where(first, START, before)
        text, word = owner[-1], h[-1]
        yield owner, before, h


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences, byte planes apart, and counts, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zlib.compress(planes.tobytes(), 1), zlib.compress(counts.astype("<u4").tobytes(), 1)


def _unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(keys), np.uint8).reshape(8, -1)
    steps = np.ascontiguousarray(planes.T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(zlib.decompress(counts), "<u4").astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sum of a bucket's parts, folded in as they come so that only sums are held."""
    keys, counts, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
    for a, b in zip(group.column("keys"), group.column("counts")):
        held.append(_unpacked(a.as_py(), b.as_py()))
        size += len(held[-1][0])
        if size > max(2_000_000, len(keys)):
            keys, counts = _summed(np.concatenate([keys, *[k for k, _ in held]]), np.concatenate([counts, *[c for _, c in held]]))
            held, size = [], 0
    return _summed(np.concatenate([keys, *[k for k, _ in held]]), np.concatenate([counts, *[c for _, c in held]]))


def _parts(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One packed row per bucket of sorted keys; buckets have to be contiguous runs of keys or are regrouped."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        packed = _packed(keys[a:b], counts[a:b])
        yield pa.record_batch([pa.array([int(bucket[a])], pa.int32()), pa.array([packed[0]]), pa.array([packed[1]])], ["bucket", "keys", "counts"])


PACKED = "bucket int, keys binary, counts binary"


class _Gather:
    """Collects keys and counts, and sums them whenever many are held."""

    def __init__(self, limit: int = 3_000_000) -> None:
        self.limit, self.keys, self.counts, self.size = limit, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> bool:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys), self.counts.append(counts)
        self.size += len(keys)
        return self.size > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _summed(np.concatenate([np.zeros(0, np.uint64), *self.keys]), np.concatenate([np.zeros(0, np.int64), *self.counts]))
        self.keys, self.counts, self.size = [], [], 0
        return out


def _folded(batch: pa.RecordBatch, column: int) -> list[bytes]:
    fold = fold_table()
    return [(t or "").encode().translate(fold) for t in batch.column(column).to_pylist()]


def _write(path: str, array: np.ndarray) -> None:
    """Write an array under a name of its own, then rename: a repeated task leaves the same file."""
    temporary = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(temporary, "wb") as f:
        np.save(f, array)
    os.replace(temporary, path)


def _mapped(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


@dataclass
class Layout:
    """Where the arrays lie, and the small facts that every task needs."""

    folder: str
    #: Words: buckets by the top bits of the hash, and each bucket's first word number.
    word_buckets: int
    first_id: list[int]
    #: Pairs: ranges of context numbers, and the contexts so frequent that their pairs are dealt apart.
    ranges: int
    hot: np.ndarray
    hot_first: np.ndarray
    hot_parts: np.ndarray
    tokens: int = 0
    words: int = 0
    discounts: tuple[float, ...] = ()
    base_discounts: tuple[float, ...] = ()
    kinds: int = 0

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word number of each hash, -1 for unknown words."""
        unique, back = np.unique(h, return_inverse=True)
        out = np.full(len(unique), -1, np.int64)
        bucket = (unique >> np.uint64(48)).astype(np.int64) * self.word_buckets >> 16
        edges = np.searchsorted(bucket, np.arange(self.word_buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            words = _mapped(self.folder, f"word-{b}")
            if len(words):
                at = np.minimum(np.searchsorted(words, unique[part]), len(words) - 1)
                out[part] = np.where(words[at] == unique[part], at + self.first_id[b], -1)
        return out[back]

    def pair_buckets(self, pairs: np.ndarray) -> np.ndarray:
        """Bucket of each pair (context number in the high half, word number in the low half)."""
        context, word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        bucket = context * self.ranges // (self.words + 1)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            is_hot = self.hot[at] == context
            apart = self.hot_first[at] + word * self.hot_parts[at] // (self.words + 1)
            bucket = np.where(is_hot, apart, bucket)
        return bucket

    def value(self, name: str, ids: np.ndarray) -> np.ndarray:
        """A per-word array's entries; ids of -1 give 0."""
        out = np.zeros(len(ids), np.float64)
        unique, back = np.unique(ids, return_inverse=True)
        got = np.zeros(len(unique))
        known = np.searchsorted(unique, 0)
        edges = np.searchsorted(unique, np.asarray([*self.first_id, self.words]))
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(max(edges[b], known), edges[b + 1])
            if part.start < part.stop:
                got[part] = _mapped(self.folder, f"{name}-{b}")[unique[part] - self.first_id[b]]
        out[:] = got[back]
        return out


def _count_words(train: DataFrame, folder: str, buckets: int) -> list[tuple[int, int, int]]:
    """Write each bucket's sorted word hashes and counts; ``(bucket, words, tokens)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gather()

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = held.take()
            yield from _parts(keys, counts, (keys >> np.uint64(48)).astype(np.int64) * buckets >> 16)

        for batch in batches:
            for _, h in _token_stream(_folded(batch, 0)):
                if held.add(h):
                    yield from out()
        yield from out()

    def write(group: pa.Table) -> pa.Table:
        keys, counts = _merged(group)
        b = group.column("bucket")[0].as_py()
        _write(f"{folder}/word-{b}.npy", keys)
        _write(f"{folder}/count-{b}.npy", counts)
        return pa.table({"bucket": pa.array([b], pa.int32()), "words": [len(keys)], "tokens": [int(counts.sum())]})

    parts = train.select("text").mapInArrow(count, PACKED)
    rows = parts.groupBy("bucket").applyInArrow(write, "bucket int, words bigint, tokens bigint").collect()
    return [(r["bucket"], r["words"], r["tokens"]) for r in rows]


def _hot_contexts(spark, layout: Layout, buckets: int, least: int) -> list[tuple[int, int]]:
    """Words with at least ``least`` tokens: there are at most ``tokens / least`` of them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                counts = _mapped(layout.folder, f"count-{b}")
                at = np.flatnonzero(counts >= least)
                yield pa.record_batch([pa.array(at + layout.first_id[b]), pa.array(np.asarray(counts[at]))], ["id", "n"])

    rows = spark.range(0, buckets, 1, min(buckets, 64)).mapInArrow(find, "id bigint, n bigint").collect()
    return sorted((r["id"], r["n"]) for r in rows)


def _discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; a missing class falls back to one half of its order."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1.0, 2.0, 3.0)))


def _discounted(counts: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.select([counts <= 0, counts == 1, counts == 2], [0.0, d[0], d[1]], d[2])


def train_model(docs: DataFrame, trains: Column, tokens_per_bucket: int = BUCKET_TOKENS) -> Layout:
    """Count words and word pairs of the rows where ``trains`` holds and write the model's arrays.

    Pairs meet in ranges of contexts. A context so frequent that its pairs would fill more than a
    bucket is split by its second word; sums per context are then added up over its parts.
    """
    spark = docs.sparkSession
    path = new_path(spark, "kneser")
    folder = local_folder(path)
    os.makedirs(folder, exist_ok=True)
    train = docs.where(trains).select(F.col("text").cast("string").alias("text"))
    # Characters bound the tokens from above; five of them make about one.
    size = train.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, min(4096, size // 5 // tokens_per_bucket + 1))
    counted = {b: (w, t) for b, w, t in _count_words(train, folder, buckets)}
    for b in range(buckets):
        if b not in counted:
            _write(f"{folder}/word-{b}.npy", np.zeros(0, np.uint64))
            _write(f"{folder}/count-{b}.npy", np.zeros(0, np.int64))
    sizes = [counted.get(b, (0, 0))[0] for b in range(buckets)]
    first = [0, *np.cumsum(sizes).tolist()]
    none = np.zeros(0, np.int64)
    layout = Layout(folder, buckets, first[:-1], buckets, none, none, none)
    layout.words, layout.tokens = first[-1], sum(t for _, t in counted.values())
    hot = _hot_contexts(spark, layout, buckets, max(1, layout.tokens // HOT_CONTEXTS, tokens_per_bucket // 8))
    if hot:
        layout.hot = np.array([i for i, _ in hot])
        layout.hot_parts = np.array([n // tokens_per_bucket + 1 for _, n in hot])
        layout.hot_first = layout.ranges + np.concatenate([[0], np.cumsum(layout.hot_parts)[:-1]])
    pairs = saved(_count_pairs(train, layout), "pairs")
    seen = pairs.agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4")]).first()
    layout.discounts = _discounts(*(seen[f"n{i}"] or 0 for i in (1, 2, 3, 4)))
    kinds = saved(_count_continuations(pairs, layout), "continuations")
    row = kinds.agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "kinds")]).first()
    layout.base_discounts = _discounts(*(row[f"n{i}"] or 0 for i in (1, 2, 3, 4)))
    layout.kinds = row["kinds"] or 0
    _write_words(kinds, pairs.select("contexts"), layout)
    _write_pairs(pairs, layout)
    return layout


def _count_pairs(train: DataFrame, layout: Layout) -> DataFrame:
    """Write each bucket's sorted pairs and counts; per bucket, packed context sums and continuation counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gather()

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = held.take()
            yield from _parts(keys, counts, layout.pair_buckets(keys))

        for batch in batches:
            for _, before, h in _with_contexts(_folded(batch, 0)):
                known = layout.ids(np.concatenate([before, h]))
                # The start is no word: its number follows the last one's.
                context = np.where(known[: len(h)] < 0, layout.words, known[: len(h)])
                if held.add(context.astype(np.uint64) << np.uint64(32) | known[len(h) :].astype(np.uint64)):
                    yield from out()
        yield from out()

    def write(group: pa.Table) -> pa.Table:
        keys, counts = _merged(group)
        b = group.column("bucket")[0].as_py()
        _write(f"{layout.folder}/pair-{b}.npy", keys)
        _write(f"{layout.folder}/times-{b}.npy", counts.astype(np.min_scalar_type(counts.max(initial=0))))
        words, kinds = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        n = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
        context = keys >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        sums = [np.add.reduceat(x.astype(np.int64), starts) for x in (counts, counts == 1, counts == 2, counts > 2)]
        packed = zlib.compress(np.stack([context[starts].astype(np.int64), *sums]).tobytes(), 1)
        a, c = _packed(words, kinds)
        return pa.table({"bucket": pa.array([b], pa.int32()), "n1": n[:1], "n2": n[1:2], "n3": n[2:3], "n4": n[3:], "contexts": [packed], "keys": [a], "counts": [c]})

    schema = "bucket int, n1 bigint, n2 bigint, n3 bigint, n4 bigint, contexts binary, keys binary, counts binary"
    return train.mapInArrow(count, PACKED).groupBy("bucket").applyInArrow(write, schema)


def _count_continuations(pairs: DataFrame, layout: Layout) -> DataFrame:
    """Number of different contexts of each word, per word bucket: ``keys`` and ``counts`` packed, and counts of counts."""
    first = np.asarray([*layout.first_id[1:], np.iinfo(np.int64).max])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, c in zip(batch.column(0), batch.column(1)):
                keys, counts = _unpacked(a.as_py(), c.as_py())
                yield from _parts(keys, counts, np.searchsorted(first, keys.astype(np.int64), "right"))

    def add(group: pa.Table) -> pa.Table:
        keys, counts = _merged(group)
        n = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
        a, c = _packed(keys, counts)
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "n1": n[:1], "n2": n[1:2], "n3": n[2:3], "n4": n[3:], "kinds": [int(counts.sum())], "keys": [a], "counts": [c]})

    schema = "bucket int, n1 bigint, n2 bigint, n3 bigint, n4 bigint, kinds bigint, keys binary, counts binary"
    return pairs.select("keys", "counts").mapInArrow(deal, PACKED).groupBy("bucket").applyInArrow(add, schema)


def _write_words(kinds: DataFrame, contexts: DataFrame, layout: Layout) -> None:
    """Per word bucket: log-free continuation probability, and what its context leaves to it."""
    first = np.asarray([*layout.first_id[1:], np.iinfo(np.int64).max])
    d, base, words, total = layout.discounts, layout.base_discounts, layout.words, layout.kinds

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                rows = np.frombuffer(zlib.decompress(text.as_py()), np.int64).reshape(5, -1)
                bucket = np.searchsorted(first, np.minimum(rows[0], words - 1), "right")
                for b in np.unique(bucket):
                    part = zlib.compress(np.ascontiguousarray(rows[:, bucket == b]).tobytes(), 1)
                    yield pa.record_batch([pa.array([int(b)], pa.int32()), pa.array([part]), pa.array([None], pa.binary()), pa.array([None], pa.binary())], ["bucket", "contexts", "keys", "counts"])

    def write(group: pa.Table) -> pa.Table:
        b = group.column("bucket")[0].as_py()
        low, n = layout.first_id[b], len(_mapped(layout.folder, f"word-{b}"))
        # One entry more: the start of a text, numbered after the last word, lies in the last bucket.
        stats = np.zeros((4, n + 1), np.int64)
        kinds = np.zeros(n + 1, np.int64)
        for c, a, k in zip(group.column("contexts"), group.column("keys"), group.column("counts")):
            if c.as_py() is not None:
                rows = np.frombuffer(zlib.decompress(c.as_py()), np.int64).reshape(5, -1)
                np.add.at(stats, (slice(None), rows[0] - low), rows[1:])
            else:
                keys, counts = _unpacked(a.as_py(), k.as_py())
                kinds[keys.astype(np.int64) - low] = counts
        total_here = np.maximum(stats[0], 1)
        left = np.where(stats[0] > 0, (d[0] * stats[1] + d[1] * stats[2] + d[2] * stats[3]) / total_here, 1.0)
        _write(f"{layout.folder}/left-{b}.npy", left.astype(np.float32))
        _write(f"{layout.folder}/total-{b}.npy", stats[0])
        share = np.maximum(kinds - _discounted(kinds, base), 0) / max(1, total)
        _write(f"{layout.folder}/share-{b}.npy", share)
        return pa.table({"bucket": pa.array([b], pa.int32()), "given": [float(_discounted(kinds, base).sum()) / max(1, total)]})

    both = contexts.mapInArrow(deal, "bucket int, contexts binary, keys binary, counts binary").unionByName(
        kinds.select("bucket", F.lit(None).cast("binary").alias("contexts"), "keys", "counts")
    )
    rows = both.groupBy("bucket").applyInArrow(write, "bucket int, given double").collect()
    # What the discounts of the continuation counts leave is spread evenly over all words and the unknown one.
    layout.base_discounts = (*base, sum(r["given"] for r in rows) / (words + 1) if rows else 1.0)


def _write_pairs(pairs: DataFrame, layout: Layout) -> None:
    """Per pair bucket: the discounted share of each pair in its context."""
    d = layout.discounts

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                keys, counts = _mapped(layout.folder, f"pair-{b}"), np.asarray(_mapped(layout.folder, f"times-{b}")).astype(np.int64)
                context = (np.asarray(keys) >> np.uint64(32)).astype(np.int64)
                total = _totals(layout, context)
                _write(f"{layout.folder}/gain-{b}.npy", ((counts - _discounted(counts, d)) / total).astype(np.float32))
                yield pa.record_batch([pa.array([b], pa.int32())], ["bucket"])

    buckets = pairs.select("bucket")
    buckets.repartition(max(1, layout.ranges + int(layout.hot_parts.sum())), "bucket").mapInArrow(write, "bucket int").count()


def _totals(layout: Layout, context: np.ndarray) -> np.ndarray:
    start = context >= layout.words
    out = layout.value("total", np.where(start, -1, context))
    if start.any():
        out[start] = _start_entry(layout, "total")
    return np.maximum(out, 1)


def _start_entry(layout: Layout, name: str) -> float:
    last = max(b for b in range(layout.word_buckets) if len(_mapped(layout.folder, f"word-{b}")) or b == 0)
    return float(_mapped(layout.folder, f"{name}-{last}")[-1])


def score(docs: DataFrame, layout: Layout, held_out: Column) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, in log10.

    ``score`` is the model's log probability of the text and its end; ``perplexity`` per token is
    ``10 ** (-score / n_tokens)``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = layout.base_discounts[-1]
        for batch in batches:
            n = batch.num_rows
            tokens, known, base, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            for owner, before, h in _with_contexts(_folded(batch, 2)):
                ids = layout.ids(np.concatenate([before, h]))
                context, word = ids[: len(h)], ids[len(h) :]
                context = np.where(before == START, layout.words, context)
                count = layout.value("count", word)
                low = layout.value("share", word) + spread
                rest = np.ones(len(h))
                is_word = (context >= 0) & (context < layout.words)
                rest[is_word] = layout.value("left", context[is_word])
                if (context == layout.words).any() and layout.words:
                    rest[context == layout.words] = _start_entry(layout, "left")
                gain = np.zeros(len(h))
                both = np.flatnonzero((context >= 0) & (word >= 0))
                gain[both] = _gains(layout, context[both].astype(np.uint64) << np.uint64(32) | word[both].astype(np.uint64))
                tokens += np.bincount(owner, minlength=n)
                known += np.bincount(owner, count > 0, n).astype(np.int64)
                base += np.bincount(owner, np.log10((count + 1) / (layout.tokens + layout.words + 1)), n)
                total += np.bincount(owner, np.log10(gain + rest * low), n)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), *map(pa.array, (tokens, known, np.full(n, layout.tokens), base, total))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out.alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _gains(layout: Layout, pairs: np.ndarray) -> np.ndarray:
    unique, back = np.unique(pairs, return_inverse=True)
    bucket = layout.pair_buckets(unique)
    order = np.argsort(bucket, kind="stable")
    out = np.zeros(len(unique))
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(unique) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        at = order[a:b]
        name = int(bucket[at[0]])
        if os.path.exists(f"{layout.folder}/pair-{name}.npy"):
            keys = _mapped(layout.folder, f"pair-{name}")
            place = np.minimum(np.searchsorted(keys, unique[at]), len(keys) - 1)
            out[at] = np.where(keys[place] == unique[at], _mapped(layout.folder, f"gain-{name}")[place], 0)
    return out[back]


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Score all texts by a model of the texts whose ``crc32(doc_id as text) mod folds`` is not ``held``.

    Null texts count as empty: one token, the end. A null doc_id is nobody's fold and trains. Words
    are lower-cased runs without white space. Repeated rows count as often as they come; extra
    columns are ignored; an empty table gives an empty result.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))
    layout = train_model(docs, ~held_out)
    return score(docs, layout, held_out)
