"""Repeated byte strings: places share a seed, their surroundings meet in a suffix array, neighbours are compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import groups, numbers, planes, squeezed, unsqueezed
from .shared import dropped, saved
from .words import chain, mix, sliced

#: Bytes of a string that counts as repeated, and of a seed. Every string holds ``SPAN`` seeds.
LENGTH, SEED = 100, 32
SPAN = LENGTH - SEED + 1
#: Bytes of text that are looked at together, and of surroundings that are sorted together.
SLICE, SORTED = 1 << 20, 2 << 20
#: Different surroundings of one seed that one task gets; those of more frequent seeds meet string by string.
CROWD = 4000
#: Surroundings that a task holds before it passes them on.
HELD = 20_000
#: Places of one seed that a slice sends to be counted.
SENT = 4
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def type_b(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor. The text ends with a 0 that occurs nowhere else."""
    later = np.zeros(len(text), np.int8)
    later[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    # A run of equal bytes is ordered as its last byte and what follows.
    at = np.where(later != 0, np.arange(len(text)), len(text) - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return later[at] > 0


def sort_directly(text: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes, eight at a time; equal ones by place."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    eight = np.ndarray((len(text) + depth + 1,), ">u8", padded, 0, (1,))
    order = which[np.argsort(eight[which].astype(np.uint64), kind="stable")]
    key = eight[order].astype(np.uint64)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    for at in range(8, depth, 8):
        group = np.cumsum(new)
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        part = order[tied]
        key = eight[part + at].astype(np.uint64)
        by = np.lexsort((key, group[tied]))
        order[tied] = part[by]
        key, group = key[by], group[tied][by]
        new[tied] = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
    return order


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The wanted suffixes (all, if not said) in the order of their first ``depth`` bytes, in two stages.

    ``text`` ends with its only 0. Suffixes smaller than their successor are sorted directly. The
    others are induced bucket by bucket (a bucket holds the suffixes of one first byte): whatever a
    bucket holds is in order, so the larger predecessors of its suffixes follow in the same order in
    their own buckets. Suffixes that no wanted one is induced from are left out.
    """
    smaller = type_b(text)
    wanted = np.ones(len(text), bool) if wanted is None else wanted
    index = np.arange(len(text))
    stop = np.maximum.accumulate(np.where(smaller, index, -1))
    needed = np.maximum.accumulate(np.where(wanted, index, -1)) > np.concatenate([[-1], stop[:-1]])
    needed[-1] = True
    direct = sort_directly(text, np.flatnonzero(smaller & needed), depth)
    counts = np.bincount(text[needed], minlength=256)
    ends = np.cumsum(counts)
    out = np.zeros(ends[-1], np.int64)
    fill = ends - counts
    first = text[direct]
    edge = np.searchsorted(first, np.arange(257))
    for c in range(256):
        out[ends[c] - (edge[c + 1] - edge[c]) : ends[c]] = direct[edge[c] : edge[c + 1]]
    out[0], fill[0] = len(text) - 1, 1

    def induce(place: np.ndarray, least: int, most: int) -> np.ndarray:
        """Append the predecessors with a byte in a range to their buckets; return those of the lowest."""
        before = place[place > 0] - 1
        byte = text[before]
        keep = needed[before] & ~smaller[before] & (byte >= least) & (byte <= most)
        before, byte = before[keep], byte[keep]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        bounds = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1], [True]])) if len(byte) else []
        for a, b in zip(bounds, bounds[1:]):
            c = byte[a]
            out[fill[c] : fill[c] + b - a] = before[a:b]
            fill[c] += b - a
        return before

    for c in range(256):
        start, top = ends[c] - counts[c], ends[c] - (edge[c + 1] - edge[c])
        new = out[start : fill[c]]
        while len(new):  # a run of this byte goes on inside the bucket
            new = induce(new, c, c)
        if counts[c]:
            induce(np.concatenate([out[start : fill[c]], out[max(top, fill[c]) : ends[c]]]), c + 1, 255)
    return out[wanted[out]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix but the first, how many bytes it shares with the one before it, ``depth`` at most."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    eight = np.ndarray((len(text) + depth + 1,), "<u8", padded, 0, (1,))
    out = np.zeros(max(0, len(order) - 1), np.int64)
    left = np.arange(len(out))
    for at in range(0, depth, 8):
        differs = eight[order[left] + at] ^ eight[order[left + 1] + at]
        same = differs == 0
        low = differs & (~differs + np.uint64(1))
        bits = np.log2(low.astype(np.float64), out=np.zeros(len(low)), where=low > 0).astype(np.int64)
        out[left] = at + np.where(same, 8, bits >> 3)
        left = left[same]
    return np.minimum(out, depth)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def seeds(data: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the seed at each place, the places whose seed is the least of a string, and where those strings begin and end.

    Texts lie between the bounds, each followed by a byte that belongs to none. Which seed of a string
    is its least, and the first of equal ones, follows from the string alone: equal strings have the
    same seed at the same place.
    """
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    h, size = mix(np.ndarray((n + 1,), "<u8", padded, 0, (1,))[: n - 7] + np.uint64(1)), 8
    while size < SEED:
        h, size = chain(h[:-size], h[size:]), 2 * size
    least = _least(h, SPAN)
    whole = np.zeros(len(least), bool)
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        whole[a : max(a, b - LENGTH)] = True
    # The greatest of the minima of all strings around a place is its own value where it is one of them.
    least = np.where(whole, ~least, _NONE)
    edge = np.full(SPAN - 1, _NONE)
    own = ~_least(np.concatenate([edge, least, edge]), SPAN)
    at = np.flatnonzero((own == h) & (own != 0))
    # Its strings hold no smaller seed, and no equal one before it.
    value, text = h[at], np.searchsorted(bound, at, "right") - 1
    low, high = np.maximum(at - SPAN + 1, bound[text]), np.minimum(at + LENGTH, bound[text + 1] - 1)
    for sign in (-1, 1):
        rows, k = np.arange(len(at)), 1
        while len(rows):
            rows = rows[(rows + sign * k >= 0) & (rows + sign * k < len(at))]
            rows = rows[np.abs(at[rows + sign * k] - at[rows]) < SPAN]
            other = rows + sign * k
            bounds = value[other] <= value[rows] if sign < 0 else value[other] < value[rows]
            if sign < 0:
                low[rows[bounds]] = np.maximum(low[rows[bounds]], at[other[bounds]] + 1)
            else:
                high[rows[bounds]] = np.minimum(high[rows[bounds]], at[other[bounds]] + SEED - 1)
            rows, k = rows[~bounds], k + 1
    some = high - low >= LENGTH
    return h, at[some], low[some], high[some]


def _slices(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Numbers, offsets and bytes of texts of about ``SLICE`` bytes together; a longer text comes in overlapping parts."""
    which, offsets, parts, held = [], [], [], 0
    for i, text in enumerate(texts):
        data, at = text.encode(), 0
        while True:
            part = data[at : at + SLICE + LENGTH - 1]
            which.append(i)
            offsets.append(at)
            parts.append(part)
            held += len(part)
            if held >= SLICE:
                yield np.array(which), np.array(offsets), parts
                which, offsets, parts, held = [], [], [], 0
            if at + len(part) >= len(data):
                break
            at += SLICE
    if parts:
        yield np.array(which), np.array(offsets), parts


def _sides(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """24 bits about what is left and right of a seed: two strings that share it share the whole of one side at least."""
    reach = (LENGTH - SEED + 1) // 2
    last = len(h) - 1
    left = chain(h[np.maximum(at - reach, 0)], h[np.maximum(at - SEED, 0)])
    right = chain(h[np.minimum(at + SEED, last)], h[np.minimum(at + reach, last)])
    return (left >> np.uint64(52)) << np.uint64(12) | right >> np.uint64(52)


def _copies(data: np.ndarray, h: np.ndarray, low: np.ndarray, at: np.ndarray, high: np.ndarray, keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of the places ``at`` with equal bytes from ``low`` to ``high``: each but the first, and the first, by ``keys``."""
    around = chain((high - low).astype(np.uint64), (at - low).astype(np.uint64))
    for o in range(0, 2 * LENGTH, SEED):
        around = chain(around, h[np.minimum(low + o, high - SEED)])
    order = np.lexsort((*keys, around))
    same = np.concatenate([[False], around[order[1:]] == around[order[:-1]]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    a, b = order[same], order[head[same]]
    equal = (high[a] - low[a] == high[b] - low[b]) & (at[a] - low[a] == at[b] - low[b])
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    for o in range(0, 2 * LENGTH, 8):
        equal &= eight[np.minimum(low[a] + o, high[a] - 8)] == eight[np.minimum(low[b] + o, high[b] - 8)]
    return a[equal], b[equal]


MET = "bucket int, seeds binary, docs binary, versions binary, places binary, seed bigint, doc_id bigint, version bigint, start int, stop int, gone boolean"
PLACES = "seed bigint, doc_id bigint, version bigint, start int, stop int, gone boolean"
SPANS = "doc_id bigint, version bigint, start int, stop int"
NAMES, FIELDS, SPAN_FIELDS = ([x.split()[0] for x in s.split(", ")] for s in (MET, PLACES, SPANS))
_SIDES = np.uint64((1 << 24) - 1)


def _places(docs: DataFrame, buckets: int) -> DataFrame:
    """Surroundings whose seed occurs at another place too, and spans that a slice of text has had before (``gone``).

    Each slice sends a seed once for the same surroundings (at the other places of them every string
    has occurred before, their bytes having been compared), and a task sends not more than ``SENT`` of a
    seed to be counted: what is more has been counted already.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(0, np.uint64)
        for batch in sliced(batches):
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for which, offsets, parts in _slices(batch.column(2).to_pylist()):
                data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
                bound = np.cumsum([0, *[len(x) + 1 for x in parts]])
                h, at, low, high = seeds(data, bound)
                if not len(at):
                    continue
                part = np.searchsorted(bound, at, "right") - 1
                base = bound[part] - offsets[part]
                # The least seeds are small numbers: spread them before they are dealt into buckets.
                doc, version, value = ids[which[part]], versions[which[part]], mix(~h[at])
                start, stop = low - base, high - base
                later, first = _copies(data, h, low, at, high, (start, version, doc))
                # A row that repeats, or the overlap of two parts, has the very same places.
                itself = (doc[later] == doc[first]) & (version[later] == version[first]) & (start[later] == start[first])
                gone = later[~itself]
                order = np.lexsort((start, version, doc, value))
                order = order[~np.isin(order, later)]
                head = np.concatenate([[True], value[order[1:]] != value[order[:-1]]])
                nth = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
                known = np.isin(value[order], often)
                full = np.unique(value[order[nth >= SENT - 1]])
                often = np.union1d(often, full)
                sent, more = order[(nth < SENT) & ~known], order[(nth >= SENT) | known]
                bucket = ((value >> np.uint64(32)).astype(np.int64) * buckets >> 32).astype(np.int32)
                edges = np.searchsorted(bucket[sent], np.arange(buckets + 1))
                spans = [(int(p), int(q)) for p, q in zip(edges, edges[1:]) if q > p]
                n = len(spans)
                named = (version.astype(np.uint64) << np.uint64(24)) | _sides(h, at)
                placed = (np.isin(value, full).astype(np.int64) << 48) | (start << 8) | (stop - start)
                packs = [pa.array([planes(x[sent[p:q]]) for p, q in spans], pa.binary()) for x in (value, doc, named, placed)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.record_batch([pa.array(bucket[sent][[p for p, _ in spans]]), *packs, *[pa.nulls(n, t) for t in kinds]], NAMES)
                gone = gone[np.argsort(low[gone], kind="stable")]
                new = np.ones(len(gone), bool)
                new[1:] = low[gone[1:]] > np.maximum.accumulate(high[gone])[:-1]
                heads = np.flatnonzero(new)
                ends = np.maximum.reduceat(stop[gone], heads) if len(gone) else stop[gone]
                rest = np.concatenate([more, gone[heads]])
                flat = [value[rest].view(np.int64), doc[rest], version[rest], start[rest].astype(np.int32), np.concatenate([stop[more], ends]).astype(np.int32), np.arange(len(rest)) >= len(more)]
                yield pa.record_batch([pa.array((mix(doc[rest].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)), *[pa.nulls(len(rest), pa.binary())] * 4, *map(pa.array, flat)], NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in groups(batches):
            value, doc, named, placed = (numbers([x for x in table[c].to_pylist() if x is not None], kind) for c, kind in zip(NAMES[1:5], ("u8", "i8", "u8", "i8")))
            order = np.lexsort((placed, named, doc, value))
            value, doc, named, placed = value[order], doc[order], named[order], placed[order]
            # Rows that repeat send the same places.
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]) | (named[1:] != named[:-1]) | (placed[1:] != placed[:-1])
            value, doc, named, placed = value[new], doc[new], named[new], placed[new]
            sides = named & _SIDES
            hit = np.zeros(len(value), bool)
            for side in (sides >> np.uint64(12), sides & np.uint64(0xFFF)):
                order = np.lexsort((side, value))
                same = np.zeros(len(value) + 1, bool)
                same[1:-1] = (value[order[1:]] == value[order[:-1]]) & (side[order[1:]] == side[order[:-1]])
                hit[order] |= same[1:] | same[:-1]
            # A seed that a slice met ``SENT`` times may share a side with what was not sent.
            hit |= np.isin(value, value[placed >> 48 > 0])
            at = (placed[hit] >> 8 & 0xFFFFFFFF).astype(np.int32)
            flat = [value[hit].view(np.int64), doc[hit], (named[hit] >> np.uint64(24)).astype(np.int64), at, at + (placed[hit] & 255).astype(np.int32), np.zeros(len(at), bool)]
            yield pa.record_batch([pa.array(x) for x in flat], FIELDS)
            yield from table.select(FIELDS).filter(pc.is_valid(table["gone"])).to_batches()

    met = docs.mapInArrow(send, MET).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(count, PLACES)


AROUND = "seed bigint, doc_id bigint, version bigint, start int, bytes binary"


def _surroundings(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The bytes around each place that strings with its seed can have: ``AROUND``."""
    per_doc = places.groupBy("doc_id", "version").agg(F.collect_list("seed").alias("seeds"), F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    names, kinds = [x.split()[0] for x in AROUND.split(", ")], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out = None, []
        for batch in batches:
            for doc, version, text, *lists in zip(*(batch.column(c) for c in range(6))):
                doc, version = doc.as_py(), version.as_py()
                if (doc, version) == before:  # a row that repeats
                    continue
                before, data = (doc, version), unsqueezed(text.as_py())
                out += [(value, doc, version, start, data[start:stop]) for value, start, stop in zip(*(x.as_py() for x in lists))]
                if len(out) >= HELD:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    joined = squeezed(docs).join(per_doc, ["doc_id", "version"]).select("doc_id", "version", "text", "seeds", "starts", "stops")
    return joined.mapInArrow(cut, AROUND)


def _spans(key: np.ndarray, names: list[tuple[int, int]]) -> pa.RecordBatch:
    """Strings that go, as document number and start in one number: joined to spans."""
    key = np.unique(key)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] > key[:-1] + LENGTH
    heads = np.flatnonzero(new)
    lasts = key[np.append(heads[1:], len(key)) - 1] if len(key) else key
    doc = (key[heads] >> 32).tolist()
    starts, stops = (key[heads] & 0xFFFFFFFF).astype(np.int32), ((lasts & 0xFFFFFFFF) + LENGTH).astype(np.int32)
    return pa.record_batch([pa.array([names[d][0] for d in doc], pa.int64()), pa.array([names[d][1] for d in doc], pa.int64()), pa.array(starts), pa.array(stops)], SPAN_FIELDS)


def later_strings(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    """Of all strings of ``LENGTH`` bytes in pieces of text ``(doc_id, version, start, bytes)``: those with an equal earlier one.

    Equal pieces need one place in the suffix array, the first; the others go as a whole. Suffixes that
    share ``LENGTH`` bytes with their neighbour are one class, and all its places but the first go.
    """
    names = sorted({r[:2] for r in rows})
    number = {name: i for i, name in enumerate(names)}
    pieces: dict[bytes, int] = {}
    gone = []
    for doc, version, start, data in rows:
        place = (number[doc, version] << 32) + start
        before = pieces.setdefault(data, place)
        if before != place:
            pieces[data] = min(before, place)
            gone.append(np.arange(max(before, place), max(before, place) + len(data) - LENGTH + 1))
    # 255 and 0 are no bytes of a shifted UTF-8 text: they stand between pieces and at the end.
    text = np.frombuffer(b"\xff".join(x.translate(_SHIFTED) for x in pieces) + b"\xff\x00", np.uint8)
    bound = np.cumsum([0, *[len(x) + 1 for x in pieces]])
    piece = np.repeat(np.arange(len(pieces)), np.diff(bound))
    whole = np.append(np.arange(len(piece)) + LENGTH < bound[piece + 1], False)
    order = suffix_array(text, LENGTH, whole)
    shared = common_prefixes(text, order, LENGTH) >= LENGTH
    at = piece[order]
    place = np.fromiter(pieces.values(), np.int64, len(pieces))[at] + order - bound[at]
    heads = np.flatnonzero(np.concatenate([[True], ~shared]))
    least = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(order))))
    return _spans(np.concatenate([place[place != least], *gone]), names)


_SHIFTED = bytes(min(b + 1, 254) for b in range(256))


def _compared(around: DataFrame) -> DataFrame:
    """Spans with an earlier equal one, from the suffix arrays of whole groups of one seed."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for _, table in groups(batches):
            new = list(zip(*(table[c].to_pylist() for c in ("doc_id", "version", "start", "bytes"))))
            rows += new
            held += sum(len(r[3]) for r in new)
            if held >= SORTED:
                yield later_strings(rows)
                rows, held = [], 0
        if rows:
            yield later_strings(rows)

    return around.repartition("seed").sortWithinPartitions("seed").mapInArrow(compare, SPANS)


def _one_by_one(around: DataFrame) -> DataFrame:
    """The same for seeds in a crowd of different surroundings: every string meets its equals by its hash of 128 bits."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, version, start, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "start", "bytes"))):
                for at in range(len(data) - LENGTH + 1):
                    out.append((hashlib.blake2b(data[at : at + LENGTH], digest_size=16).digest(), doc, version, start + at))
            columns = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int32()))], ["string", "doc_id", "version", "start"])

    found = saved(around.mapInArrow(strings, "string binary, doc_id bigint, version bigint, start int").distinct(), "strings")
    first = found.groupBy("string").agg(F.min(F.struct("doc_id", "version", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = found.join(first, "string").where(F.struct("doc_id", "version", "start") != F.col("first"))
    return later.select("doc_id", "version", "start", (F.col("start") + LENGTH).cast("int").alias("stop"))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.xxhash64(text).bitwiseAND(F.lit((1 << 40) - 1))).alias("version"), text.alias("text"))


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, start, stop)``: spans of bytes in strings of ``LENGTH`` bytes that occur earlier too.

    Earlier is a smaller doc_id, or the same document and a smaller offset. Offsets count UTF-8
    bytes, ``stop`` exclusive; spans of a document may overlap. ``version`` tells the texts of one
    doc_id apart and orders them; equal rows are one document. Null ids have no spans, nor have null
    texts and those shorter than ``LENGTH``; an empty table has none; extra columns are ignored.
    Texts of any length are taken in overlapping parts.

    Every string of ``LENGTH`` bytes marks some of its seeds (``seeds``). Only places whose seed occurs
    twice go on: the bytes around them meet by seed, in a suffix array of a few megabytes. Seeds with
    more than ``CROWD`` places left meet string by string instead, so no task has them all.
    """
    docs = _texts(docs).where("doc_id is not null")
    long = docs.where(F.octet_length("text") >= LENGTH)
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = saved(_places(long, parallel), "places")
    left = places.where("not gone").drop("gone")
    crowds = saved(left.groupBy("seed").count().where(F.col("count") > CROWD).select("seed"), "crowds")
    spans = places.where("gone").select(*SPAN_FIELDS).unionByName(_compared(_surroundings(long, left.join(crowds, "seed", "left_anti"))))
    if not crowds.isEmpty():
        spans = spans.unionByName(_one_by_one(_surroundings(long, left.join(crowds, "seed", "left_semi"))))
    spans = saved(spans, "byte-spans")
    dropped(places, crowds)
    return spans


def without_repeated_bytes(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row of ``docs``.

    The bytes of ``repeated_bytes`` are removed; ``n_spans`` counts maximal removed runs and
    ``kept_sha256`` is the digest of what stays, joined. A null text counts as empty; a row with a
    null id loses nothing; equal rows have equal results.
    """
    spans = repeated_bytes(docs).groupBy("doc_id", "version").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    joined = squeezed(_texts(docs)).join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "starts", "stops")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, starts, stops in zip(*(batch.column(c) for c in range(4))):
                data, runs, end = unsqueezed(text.as_py()), [], 0
                for a, b in sorted(zip(starts.as_py() or (), stops.as_py() or ())):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                digest = hashlib.sha256()
                for a, b in runs:
                    digest.update(data[end:a])
                    end = b
                digest.update(data[end:])
                out.append((doc.as_py(), len(data), sum(b - a for a, b in runs), len(runs), digest.hexdigest()))
            columns = list(zip(*out)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(keep, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def oracle() -> str:
    """DuckDB SQL for the same rows: every string by itself, as hexadecimal digits. For distinct ids that are not null."""
    return f"""
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
parts as (select doc_id, base, substring(x, 2 * base + 1, {2 * (LENGTH + 127)}) as p from (select doc_id, x, unnest(range(0, len(x) // 2, 128)) as base from docs)),
strings as (select doc_id, base, p, unnest(range(0, least(128, len(p) // 2 - {LENGTH} + 1))) as o from parts where len(p) >= {2 * LENGTH}),
hashed as (select doc_id, base + o as start, md5_number(substring(p, 2 * o + 1, {2 * LENGTH})) as h from strings),
later as (select doc_id, start from (select doc_id, start, row_number() over (partition by h order by doc_id, start) as nth from hashed) where nth > 1),
edges as (select doc_id, start, case when start <= lag(start) over w + {LENGTH} then 0 else 1 end as new from later window w as (partition by doc_id order by start)),
numbered as (select doc_id, start, sum(new) over (partition by doc_id order by start) as run from edges),
runs as (select doc_id, run, min(start) as a, max(start) + {LENGTH} as b from numbered group by all),
gaps as (select r.doc_id, a, b, coalesce(lag(b) over (partition by r.doc_id order by a), 0) as before, x from runs r join docs using (doc_id)),
kept as (select doc_id, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' order by a) || substring(any_value(x), 2 * max(b) + 1) as k, sum(b - a) as removed, count(*) as n
         from gaps group by doc_id)
select doc_id, (len(x) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans, sha256(unhex(coalesce(k, x))) as kept_sha256
from docs left join kept using (doc_id)"""
