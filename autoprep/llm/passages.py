"""Substring deduplication: paragraphs by MinHash banding, and passages inside paragraphs by equal word runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .packed import groups, numbers, planes, squeezed, unsqueezed
from .shared import dropped, released, saved
from .tiles import meeting_tiles
from .vectors import linked_labels
from .words import chain, fold_table, hash_spans, mix, pieces, sliced, word_spans

SHINGLE, JACCARD = 5, 0.8
#: Rows and bands: two paragraphs at the threshold miss each other in 1 - (1 - 0.8**3)**8, 3 of 1000 cases.
ROWS, BANDS = 3, 8
#: Words of the shortest line that is a paragraph, and of the shortest run that counts as repeated.
PARAGRAPH_WORDS = RUN_WORDS = 10
TILE_ROWS = 1000
#: Texts are taken in chunks of neighbouring ids of so many bytes, at least and at most.
CHUNK_LEAST, CHUNK_MOST, CHUNKS = 1 << 20, 8 << 20, 400
#: Runs that one group of hashes holds at a time, about.
BUCKET_RUNS = 1 << 20
_SEEDS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)

UNITS = "doc_id bigint, version bigint, kind int, start int, stop int, words int, h bigint, bands array<bigint>"


def _run_hashes(h: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the word sequence of each run that starts at ``starts``."""
    place = np.arange(len(h)) - np.repeat(starts, size)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _STEP)]), dtype=np.uint64)
    return mix(np.add.reduceat(mix(h) * power[place], starts) + size.astype(np.uint64))


def _units(which: list[int], parts: list[bytes], fold: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """For a group of texts: text, kind, start, stop (bytes of the piece), words, hash and bands of each unit."""
    whole = b" ".join(parts)
    raw, data = np.frombuffer(whole, np.uint8), np.frombuffer(whole.translate(fold), np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return
    h = hash_spans(data, starts, ends)
    piece = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts, "right")
    line = np.cumsum(raw == 10)[starts]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (piece[1:] != piece[:-1])])
    paragraph = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    size = np.diff(np.append(firsts, len(h)))

    long = size >= PARAGRAPH_WORDS
    if long.any():
        shingle = h.copy()
        for k in range(1, SHINGLE):
            shingle[:-k] = chain(shingle[:-k], h[k:])
        inside = np.flatnonzero((np.arange(len(h)) + SHINGLE <= np.repeat(firsts + size, size)) & np.repeat(long, size))
        owner, values = paragraph[inside], shingle[inside]
        edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        least = [np.minimum.reduceat(mix(values ^ seed), edge) for seed in _SEEDS]
        bands = []
        for b in range(BANDS):
            band = least[b * ROWS]
            for r in range(1, ROWS):
                band = chain(band, least[b * ROWS + r])
            bands.append(band)
        f, n = firsts[long], size[long]
        yield piece[f], np.ones(len(f), np.int32), starts[f], ends[f + n - 1], n, _run_hashes(h, firsts, size)[long], np.stack(bands, 1)


def _mine(docs: DataFrame) -> DataFrame:
    """Paragraphs (lines, kind 1) of all documents with their bands. Offsets count characters."""
    fold = fold_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            done = np.zeros(batch.num_rows, np.int64)
            for which, parts in pieces([t.encode() for t in batch.column(2).to_pylist()]):
                which = np.asarray(which)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(b" ".join(parts) + b" ", np.uint8) & 0xC0) != 0x80)])
                bound = np.cumsum([0, *[len(p) + 1 for p in parts]])
                # Characters of a text before its piece: pieces of one text follow one another.
                own = chars[bound[1:] - 1] - chars[bound[:-1]]
                before = np.zeros(len(parts), np.int64)
                for i, (w, n) in enumerate(zip(which.tolist(), own.tolist())):
                    before[i] = done[w]
                    done[w] += n
                for piece, kind, start, stop, words, h, bands in _units(which.tolist(), parts, fold):
                    at = [chars[x] - chars[bound[piece]] + before[piece] for x in (start, stop)]
                    text = which[piece]
                    lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.ravel().view(np.int64)))
                    yield pa.record_batch(
                        [
                            pa.array(ids[text]), pa.array(versions[text]), pa.array(kind), pa.array(at[0].astype(np.int32)),
                            pa.array(at[1].astype(np.int32)), pa.array(words.astype(np.int32)), pa.array(h.view(np.int64)), lists,
                        ],
                        ["doc_id", "version", "kind", "start", "stop", "words", "h", "bands"],
                    )

    return docs.select("doc_id", "version", "text").mapInArrow(run, UNITS)


def _near_paragraphs(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between different paragraphs of Jaccard similarity at or above the threshold.

    Paragraphs that share a band meet in tiles and are compared exactly, from their text.
    """
    keyed = classes.select("h", F.posexplode("first.bands").alias("n", "band")).select("h", F.xxhash64("n", "band").alias("key"))
    keyed = saved(keyed, "bands")
    met = saved(meeting_tiles(keyed, "key", "h", TILE_ROWS), "met")
    wanted = met.select("h").distinct().join(classes, "h").select("h", "first.doc_id", "first.version", "first.start", "first.stop")
    line = F.expr("substring(text, start + 1, stop - start)").alias("line")
    wanted = saved(wanted, "wanted")
    texts = saved(docs.join(wanted, ["doc_id", "version"]).select("h", line).dropDuplicates(["h"]), "lines")
    fold = fold_table()

    def similar(ids: list[int], lines: list[str]) -> Iterator[tuple[int, int]]:
        sets = []
        for text in lines:
            words = [w for w in text.encode().translate(fold).split(b" ") if w]
            sets.append(set(zip(*(words[i:] for i in range(SHINGLE)))) or {tuple(words)})
        if len(sets) == 2:
            common = len(sets[0] & sets[1])
            if common >= JACCARD * (len(sets[0]) + len(sets[1]) - common) - 1e-9:
                yield ids[1], ids[0]
            return
        holders: dict[tuple, list[int]] = {}
        for i, s in enumerate(sets):
            for x in s:
                holders.setdefault(x, []).append(i)
        common = np.zeros((len(ids), len(ids)), np.int32)
        for members in holders.values():
            if len(members) > 1:
                common[np.ix_(members, members)] += 1
        size = np.array([len(s) for s in sets])
        a, b = np.nonzero(np.triu(common >= JACCARD * (size[:, None] + size[None, :] - common) - 1e-9, 1) & (common > 0))
        root = linked_labels(len(ids), a, b).tolist()
        yield from ((ids[i], ids[r]) for i, r in enumerate(root) if i != r)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; most groups are two lines, too small for a frame of their own."""
        now, ids, lines = None, [], []
        for batch in batches:
            out = []
            for key, tile_a, tile_b, h, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, tile_a, tile_b) != now:
                    if len(ids) > 1:
                        out.extend(similar(ids, lines))
                    now, ids, lines = (key, tile_a, tile_b), [], []
                ids.append(h)
                lines.append(line)
            yield pa.record_batch([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["a", "b"])
        if len(ids) > 1:
            out = list(similar(ids, lines))
            yield pa.record_batch([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], ["a", "b"])

    group = ["key", "tile_a", "tile_b"]
    rows = met.join(texts, "h").select(*group, "h", "line")
    rows = rows.repartition(*group).sortWithinPartitions(*group, "h")
    links = saved(rows.mapInArrow(compare, "a bigint, b bigint").distinct(), "similar")
    dropped(keyed, met, wanted, texts)
    released(docs.sparkSession)
    return links


def _repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, start, stop, words, first_doc)`` of each line that is not the first of its class."""
    units = saved(_mine(docs), "units")
    place = F.struct("doc_id", "version", "start")
    first = F.min(F.struct("doc_id", "version", "start", "stop", "bands")).alias("first")
    classes = saved(units.groupBy("h").agg(first, F.count("*").alias("n")), "paragraphs")
    grouped = saved(components(_near_paragraphs(classes, docs)), "near")
    named = classes.select("h", "n", F.struct("first.doc_id", "first.version", "first.start").alias("first")).join(
        grouped, classes.h == grouped.node, "left"
    )
    named = saved(named.select("h", "n", "first", F.coalesce("component", "h").alias("component")), "named")
    owner = named.groupBy("component").agg(F.min("first").alias("keeper"), F.sum("n").alias("all")).where("all > 1")
    kept = saved(named.join(saved(owner, "owners"), "component").select("h", "keeper"), "keepers")
    hits = units.join(kept, "h").where(place != F.col("keeper"))
    # Equal rows are one document.
    hits = saved(hits.select("doc_id", "version", "start", "stop", "words", F.col("keeper.doc_id").alias("first_doc")).distinct(), "hits")
    dropped(units, classes, grouped, named, kept)
    released(docs.sparkSession)
    return hits


class _Chunk:
    """Words of the texts of one chunk in the order of their places, and the hash of each run of ``RUN_WORDS``."""

    def __init__(self, rows: pa.Table, fold: bytes):
        texts, hits = {}, {}
        for doc, version, text, start, stop, words, first in zip(*(rows[c].to_pylist() for c in PLACED)):
            if text is not None:
                texts[doc, version] = text
            elif start is not None:
                hits.setdefault((doc, version), []).append((start, stop, words, first))
        self.names = sorted(texts)
        self.hits = [sorted(hits.get(name, ())) for name in self.names]
        parts = [unsqueezed(texts[name]) for name in self.names]
        whole = b" ".join(parts)
        bound = np.cumsum([0, *[len(p) + 1 for p in parts]])
        starts, ends = word_spans(data := np.frombuffer(whole.translate(fold), np.uint8))
        h = hash_spans(data, starts, ends)
        self.doc = np.searchsorted(bound, starts, "right") - 1
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(whole, np.uint8) & 0xC0) != 0x80)])
        before = chars[bound[:-1]][self.doc]
        self.start, self.stop = chars[starts] - before, chars[ends] - before
        # Words of paragraphs that go are no place that could stay.
        gone = np.zeros(len(h) + 1, np.int64)
        at = (self.doc << 32) + self.start
        for d, spans in enumerate(self.hits):
            for start, stop, *_ in spans:
                gone[np.searchsorted(at, (d << 32) + start)] += 1
                gone[np.searchsorted(at, (d << 32) + stop)] -= 1
        gone = np.concatenate([[0], np.cumsum(np.cumsum(gone)[:-1] > 0)])
        n = max(0, len(h) - RUN_WORDS + 1)
        self.at = np.flatnonzero((self.doc[:n] == self.doc[len(h) - n :]) & (gone[RUN_WORDS:][:n] == gone[:n]))
        two = chain(h[:-1], h[1:])
        four = chain(two[:-2], two[2:])
        eight = chain(four[:-4], four[4:])
        self.run = chain(eight[:n], two[8:][:n])[self.at]
        self.ids = np.array([name[0] for name in self.names], np.int64)


PLACED = ["doc_id", "version", "text", "start", "stop", "words", "first_doc"]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, start, stop, words, first_doc)``: parts of texts that repeat an earlier place.

    Paragraphs (lines of at least ``PARAGRAPH_WORDS`` words) whose 5-word shingles are similar to 0.8
    form classes by connected components; of each the place with the smallest doc_id and offset
    stays. In what is left every run of ``RUN_WORDS`` words, also across line breaks, is compared:
    the first place of each run stays, and words of a later one go. Overlapping and touching runs are
    one span. A run that overlaps its own first place, as in a text of one repeated word, is left
    alone. Offsets are characters, ``stop`` exclusive. ``version`` tells texts of one doc_id apart;
    equal rows are one document. Null ids and null, empty or blank texts have no spans; an empty
    table has none; extra columns are ignored.

    Chunks are ranges of doc_id, so a run's first place is in the first chunk that holds it: each chunk
    sends its different runs once, and gets back those that an earlier one holds.
    """
    docs = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string")).alias("version"), F.col("text").cast("string")
    )
    hits = _repeated_paragraphs(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(total // min(max(total // CHUNKS, CHUNK_LEAST), CHUNK_MOST)) + 1
    share = [(k + 1) / chunks for k in range(chunks - 1)]
    bounds = docs.agg(F.percentile_approx("doc_id", share, 20 * chunks).alias("b")).first()["b"] if share else []
    chunk = F.size(F.filter(F.lit(bounds), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    # A word has six bytes about.
    bits = max(1, int(total // (6 * BUCKET_RUNS)).bit_length())
    fold = fold_table()

    none = [F.lit(None).cast("int").alias(c) for c in ("start", "stop", "words")]
    rows = squeezed(docs).select("doc_id", "version", "text", *none, F.lit(None).cast("bigint").alias("first_doc")).unionByName(
        hits.withColumn("text", F.lit(None).cast("binary"))
    )
    rows = rows.select(chunk.alias("chunk"), *PLACED)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in groups(batches):
            c = _Chunk(table, fold)
            run, first = np.unique(c.run, return_index=True)
            docs_of = c.ids[c.doc[c.at[first]]]
            bucket = (run >> np.uint64(64 - bits)).astype(np.int64)
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(run)] if len(run) else [0]
            spans = list(zip(edges, edges[1:]))
            yield pa.record_batch(
                [
                    pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.array([chunk] * len(spans), pa.int32()),
                    pa.array([planes(run[a:b]) for a, b in spans], pa.binary()), pa.array([planes(docs_of[a:b]) for a, b in spans], pa.binary()),
                ],
                ["bucket", "chunk", "runs", "firsts"],
            )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in groups(batches):
            packed = table["runs"].to_pylist()
            run, doc = numbers(packed, "u8"), numbers(table["firsts"].to_pylist(), "i8")
            chunk = np.repeat(table["chunk"].to_numpy(), [len(b) // 8 for b in packed])
            order = np.lexsort((chunk, run))
            run, doc, chunk = run[order], doc[order], chunk[order]
            new = np.concatenate([[True], run[1:] != run[:-1]])
            doc = doc[np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))]
            later = np.flatnonzero(~new)
            later = later[np.argsort(chunk[later], kind="stable")]
            to = chunk[later]
            edges = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1), len(to)] if len(to) else [0]
            spans = list(zip(edges, edges[1:]))
            yield pa.record_batch(
                [
                    pa.array([int(to[a]) for a, _ in spans], pa.int32()),
                    pa.array([planes(run[later[a:b]]) for a, b in spans], pa.binary()), pa.array([planes(doc[later[a:b]]) for a, b in spans], pa.binary()),
                ],
                ["chunk", "runs", "firsts"],
            )

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in groups(batches):
            c = _Chunk(table, fold)
            known = numbers([b for b in table["runs"].to_pylist() if b is not None], "u8")
            owner = numbers([b for b in table["firsts"].to_pylist() if b is not None], "i8")
            order = np.argsort(known)
            known, owner = known[order], owner[order]
            run, first, which = np.unique(c.run, return_index=True, return_inverse=True)
            near = np.minimum(np.searchsorted(known, run), max(len(known) - 1, 0))
            before = known[near] == run if len(known) else np.zeros(len(run), bool)
            begin = c.at[first]
            holder = np.where(before, owner[near] if len(known) else 0, c.ids[c.doc[begin]] if len(run) else 0)
            begin = begin[which]
            apart = (c.doc[begin] != c.doc[c.at]) | (begin + RUN_WORDS <= c.at)
            hit = np.flatnonzero(before[which] | apart)
            at = c.at[hit]
            new = np.concatenate([[True], (c.doc[at[1:]] != c.doc[at[:-1]]) | (at[1:] > at[:-1] + RUN_WORDS)])[: len(at)]
            heads = np.flatnonzero(new)
            lasts = at[np.append(heads[1:], len(at)) - 1] + RUN_WORDS - 1 if len(at) else at
            out = [
                (*c.names[d], s, e, n, f)
                for d, s, e, n, f in zip(
                    c.doc[at[heads]].tolist(), c.start[at[heads]].tolist(), c.stop[lasts].tolist(),
                    (lasts - at[heads] + 1).tolist(), holder[which[hit[heads]]].tolist(),
                )
            ]
            out += [(*name, *span) for name, spans in zip(c.names, c.hits) for span in spans]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64()] * 2 + [pa.int32()] * 3 + [pa.int64()])],
                ["doc_id", "version", "start", "stop", "words", "first_doc"],
            )

    sent = rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(send, "bucket int, chunk int, runs binary, firsts binary")
    sent = sent.repartition("bucket").sortWithinPartitions("bucket")
    answers = saved(sent.mapInArrow(answer, "chunk int, runs binary, firsts binary"), "answers")
    released(docs.sparkSession)
    both = rows.unionByName(answers, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk")
    return both.mapInArrow(mark, "doc_id bigint, version bigint, start int, stop int, words int, first_doc bigint")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated spans; a text of which nothing but white space stays goes as a whole.

    All columns stay; ``n_chars`` follows the text where there is such a column. Texts without
    spans, null and empty ones are returned as they are.
    """
    spans = saved(repeated_spans(docs.select("doc_id", "text")), "spans")
    per_doc = spans.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    per_doc = saved(per_doc.select(F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), "__spans"), "cuts")
    ends = F.expr("concat(transform(__spans, s -> s.start), array(length(text)))")
    begins = F.expr("concat(array(0), transform(__spans, s -> s.stop))")
    left = F.expr("array_join(zip_with(__begins, __ends, (b, e) -> substring(text, b + 1, greatest(e - b, 0))), '')")
    joined = docs.join(per_doc, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__version")), "left")
    joined = joined.withColumn("__begins", begins).withColumn("__ends", ends)
    cut = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(left)
    out = joined.withColumn("__left", cut).where("__spans is null or __left rlike '[^ \\t-\\r]'")
    columns = [F.col("__left").alias(c) if c == "text" else F.length("__left").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)
