"""SimHash near-duplicates through tables of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import saved

BLOCKS, BLOCK_BITS = 4, 16
#: Members of a block group up to which its pairs are listed; beyond, flipped bits link it in linear work.
LISTED = 32
SHINGLES_AT_ONCE = 1 << 18


def _shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    if len(words) < size:
        return iter([b" ".join(words)])
    return map(b" ".join, zip(*(words[i:] for i in range(size))))


def _fingerprint(text: str | None, size: int, seed: int) -> int:
    """Majority bits over the shingle hashes of one text, in arrays of bounded size."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and white space 0x09 to 0x0D and 0x20.
    words = (text or "").encode().lower().split()
    ones, total = np.zeros(64, np.int64), max(1, len(words) - size + 1) if words else 0
    if not total:
        return 0
    hashes = map(xxhash.xxh64_intdigest, _shingles(words, size), repeat(seed))
    for at in range(0, total, SHINGLES_AT_ONCE):
        part = np.fromiter(hashes, np.uint64, min(SHINGLES_AT_ONCE, total - at))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, version, fp)``, version being the text's hash: a bit is 1 if it is set in over half of the text's shingle hashes.

    Null, empty and blank texts have the fingerprint 0; a text of fewer words than a shingle is one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_fingerprint(text.as_py(), size, seed) for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], ["doc_id", "version", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint"), text, F.xxhash64(text).alias("version")).mapInArrow(run, "doc_id bigint, version bigint, fp bigint")


def _walsh(size: int) -> list[int]:
    """The rows of a Hadamard matrix as bit patterns: reference fingerprints that lie as far apart as can be."""
    return [sum(1 << j for j in range(size) if bin(i & j).count("1") % 2) for i in range(size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fps: DataFrame, name: str = "fp") -> DataFrame:
    """Add ``d``, the distances to 64 reference fingerprints, block by block.

    ``d[16 * b + r]`` is the Hamming distance between block ``b`` and reference ``r``'s block. A full
    reference is one of the 16 patterns in each block, plain or inverted, so its whole distance is a
    sum of such entries or of their complements.
    """
    refs = _walsh(BLOCK_BITS)
    cells = [
        f"bit_count(({name} ^ {_signed(r << BLOCK_BITS * b)}L) & {_signed(((1 << BLOCK_BITS) - 1) << BLOCK_BITS * b)}L)"
        for b in range(BLOCKS) for r in refs
    ]
    return fps.withColumn("d", F.expr(f"array({', '.join(cells)})"))


def near_links(fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of distinct fingerprints within two bits.

    Two differing bits touch at most two of four blocks, so the distances of two blocks to all their
    references agree. Rows meet on those; pairs whose distances to some whole reference differ by
    more than two are discarded, and the rest is verified. Where more than ``LISTED`` fingerprints
    agree on two blocks, pairs are not listed: each emits itself and its one-bit neighbours, and
    fingerprints within two bits share one of these, in groups of at most 65.
    """
    table = pivot_table(fps.select("fp"))
    block = [F.slice("d", BLOCK_BITS * b + 1, BLOCK_BITS) for b in range(BLOCKS)]
    keys = [F.xxhash64(F.lit(i * BLOCKS + j), block[i], block[j]) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]
    keyed = saved(table.select("fp", "d", F.explode(F.array(*keys)).alias("key")).select("fp", "d", "key"), "pivots")
    sizes = saved(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "pivot-groups")
    met = keyed.join(sizes, "key")
    listed = met.where(f"n <= {LISTED}")
    a = listed.select("key", F.col("fp").alias("a"), F.col("d").alias("da"))
    b = listed.select("key", F.col("fp").alias("b"), F.col("d").alias("db"))
    signs = _walsh(BLOCKS)
    whole = lambda d, s: " + ".join(
        f"({BLOCK_BITS} - {d}[{BLOCK_BITS * t} + r])" if s >> t & 1 else f"{d}[{BLOCK_BITS * t} + r]" for t in range(BLOCKS)
    )
    close = " and ".join(f"abs({whole('da', s)} - ({whole('db', s)})) <= 2" for s in signs)
    pairs = (
        a.join(b, "key").where("a < b").where(F.expr(f"forall(sequence(0, {BLOCK_BITS - 1}), r -> {close})"))
        .where("bit_count(a ^ b) <= 2").select("a", "b")
    )
    bits = ", ".join(f"{_signed(1 << i)}L" for i in range(64))
    flips = (
        met.where(f"n > {LISTED}").select("fp").distinct()
        .select("fp", F.explode(F.expr(f"transform(array(0L, {bits}), x -> fp ^ x)")).alias("near"))
        .groupBy("near").agg(F.array_sort(F.collect_list("fp")).alias("all")).where("size(all) > 1")
    )
    stars = flips.select(F.col("all")[0].alias("a"), F.explode(F.expr("slice(all, 2, size(all))")).alias("b"))
    return pairs.union(stars).distinct()


def simhash_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, fp, component, component_id)``: the smallest doc_id reachable over links of two or fewer bits.

    ``version`` (hash of the text) and ``component`` (a fingerprint) tell texts and groups apart where ids repeat.

    Repeated rows and exact copies share a fingerprint and hence a component. A null doc_id keeps
    its row, with the component of its fingerprint's smallest id (null if there is none). An empty
    table gives an empty result; extra columns are ignored.
    """
    fps = saved(fingerprints(docs), "fingerprints")
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    linked = saved(components(near_links(distinct)), "linked")
    owner = (
        distinct.join(linked, distinct.fp == linked.node, "left")
        .select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    )
    owner = saved(owner, "owner")
    least = owner.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = saved(owner.join(least, "component").select("fp", "component", "component_id"), "ids")
    return fps.join(ids, "fp").select("doc_id", "version", "fp", "component", "component_id")
