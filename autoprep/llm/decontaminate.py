"""Benchmark decontamination: latent semantic search over passages, then subsequence and answer checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .arrays import summed_array
from .shared import saved
from .words import fold_table, hashed_words

#: Words of a passage of the index, and the longest query; a longer benchmark text is several queries.
PASSAGE, QUERY = 32, 64
RANK, OVERSAMPLE = 96, 16
#: Terms in more than this share of the passages tell nothing about a benchmark text and get no weight.
COMMON, ALWAYS_RARE = 0.005, 20
#: A window is a candidate from this part of the cosine that a copy among average text has, and from COSINE at the latest.
PART, COSINE, LEAST = 0.5, 0.35, 0.2
#: A copy keeps this share of the query's words in order; a paraphrase less, but with the answer in one piece.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 4
SHORTEST = 5
#: Benchmark texts searched for in one go: bounds what every task holds.
ITEMS_AT_ONCE = 5000
#: Cells of the passages' term marks at once.
MARKS = 32_000_000


def _fold(texts: list[str | None]) -> list[bytes]:
    table = fold_table(letters_only=True)
    return [(t or "").lower().encode().translate(table) for t in texts]


@dataclass
class Queries:
    """A block of benchmark texts: their terms' sorted hashes, and word codes (1 + term number) per query."""

    terms: np.ndarray
    item: list[int]
    codes: list[np.ndarray]

    def encode(self, h: np.ndarray) -> np.ndarray:
        """Codes of words; 0 for words in no benchmark text."""
        out = np.zeros(len(h), np.uint32)
        some = np.zeros(1 << 16, bool)
        some[(self.terms >> np.uint64(48)).astype(np.int64)] = True
        maybe = np.flatnonzero(some[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
        out[maybe] = np.where(self.terms[at] == h[maybe], at + 1, 0)
        return out


def _queries(items: list[Row]) -> Queries:
    words: dict[int, np.ndarray] = {}
    for owner, h, _ in hashed_words(_fold([r["text"] for r in items])):
        for i in np.unique(owner):
            words[i] = np.concatenate([words.get(i, np.zeros(0, np.uint64)), h[owner == i]])
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *words.values()]))
    ids, codes = [], []
    for i, h in words.items():
        count = -(-len(h) // QUERY)
        for part in np.array_split(h, count):
            if len(part) >= SHORTEST or count == 1:
                ids.append(items[i]["item_id"])
                codes.append((np.searchsorted(terms, part) + 1).astype(np.int64))
    return Queries(terms, ids, codes)


def _encoded(docs: DataFrame, queries: Queries) -> DataFrame:
    """``(doc_id, codes)``: each document as the codes of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for owner, h, _ in hashed_words(_fold(batch.column(1).to_pylist())):
                codes = queries.encode(h)
                edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(owner) else [0]
                for a, b in zip(edges[:-1], edges[1:]):
                    held[owner[a]].append(codes[a:b].tobytes())
            yield pa.record_batch([batch.column(0), pa.array([b"".join(x) for x in held], pa.binary())], ["doc_id", "codes"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, codes binary")


def _passages(column: pa.Array, at_once: int = 2_000_000) -> Iterator[tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]]:
    """Row numbers and codes of some documents, with passage number and term of every word that has a code.

    Each document's passages are followed by an empty one, so passages of two documents never touch.
    """
    rows, held, size = [], [], 0
    for i, text in enumerate(column):
        codes = np.frombuffer(text.as_py() or b"", np.uint32)
        rows.append(i), held.append(codes)
        size += len(codes)
        if size > at_once or i == len(column) - 1:
            first = np.cumsum([0, *[-(-len(c) // PASSAGE) + 1 for c in held]])
            where = [np.flatnonzero(c) for c in held]
            passage = np.concatenate([f + w // PASSAGE for f, w in zip(first, where)])
            term = np.concatenate([c[w].astype(np.int64) - 1 for c, w in zip(held, where)])
            yield rows, held, first, np.stack([passage, term])
            rows, held, size = [], [], 0


def _frequencies(encoded: DataFrame, terms: int) -> tuple[np.ndarray, float]:
    """Passages that hold each term, and all passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(terms + 1)
        for batch in batches:
            for _, held, first, (passage, term) in _passages(batch.column(0)):
                # Which passage holds which term, for as many passages at once as fit into the bound.
                rows = max(1, MARKS // max(1, terms))
                for at in range(0, int(first[-1]), rows):
                    low, high = np.searchsorted(passage, (at, at + rows))
                    marks = np.zeros((min(rows, int(first[-1]) - at), terms), bool)
                    marks[passage[low:high] - at, term[low:high]] = True
                    out[:terms] += marks.sum(0)
                out[terms] += sum(-(-len(c) // PASSAGE) for c in held)
        return out

    total = summed_array(encoded.select("codes"), terms + 1, count)
    return total[:terms], total[terms]


def _product(encoded: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``A' A right`` for the TF-IDF matrix ``A`` of all passages, one pass over them."""
    terms, rank = right.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out, thin = np.zeros((terms, rank)), right.astype(np.float32)
        for batch in batches:
            for _, _, _, (passage, term) in _passages(batch.column(0), 500_000):
                some = idf[term] > 0
                both, times = np.unique(passage[some] * terms + term[some], return_counts=True)
                for at in range(0, len(both), 200_000):
                    # A passage cut at a border counts as two; borders are far apart.
                    p, t = both[at : at + 200_000] // terms, both[at : at + 200_000] % terms
                    weight = (times[at : at + 200_000] * idf[t]).astype(np.float32)[:, None]
                    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                    latent = np.add.reduceat(weight * thin[t], starts)
                    spread = np.repeat(latent, np.diff(np.append(starts, len(p))), axis=0) * weight
                    order = np.argsort(t, kind="stable")
                    firsts = np.flatnonzero(np.concatenate([[True], np.diff(t[order]) != 0]))
                    out[t[order][firsts]] += np.add.reduceat(spread[order], firsts)
        return out.ravel()

    return summed_array(encoded.select("codes"), terms * rank, multiply).reshape(terms, rank)


def latent_space(encoded: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors of all passages' TF-IDF matrix, by a randomised range finder.

    Two passes: the Gram matrix times a random matrix spans the range, and its product with that
    range's basis gives the small matrix whose eigenvectors turn the basis into singular vectors.
    """
    width = min(rank + OVERSAMPLE, len(idf))
    basis, _ = np.linalg.qr(_product(encoded, idf, np.random.default_rng(seed).standard_normal((len(idf), width))))
    small = basis.T @ _product(encoded, idf, basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return basis @ vectors[:, np.argsort(-values)[:rank]]


def _term_bits(row: np.ndarray, term: np.ndarray, rows: int, terms: int) -> np.ndarray:
    """One bit per term and row."""
    bits = np.zeros((rows, terms // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (row, term >> 6), np.uint64(1) << (term & 63).astype(np.uint64))
    return bits


def _shared(bits: np.ndarray, row: np.ndarray, asked: np.ndarray, query: np.ndarray, cells: int = 4_000_000) -> np.ndarray:
    """Different terms that a row and a query have in common, pair by pair, in bounded strips."""
    out, strip = np.zeros(len(row), np.int64), max(1, cells // bits.shape[1])
    for at in range(0, len(row), strip):
        part = slice(at, at + strip)
        out[part] = np.bitwise_count(bits[row[part]] & asked[query[part]]).sum(1, dtype=np.int64)
    return out


def subsequence(query: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of the query."""
    places: dict[int, int] = {}
    for i, w in enumerate(query.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    row, full = (1 << len(query)) - 1, (1 << len(query)) - 1
    for w in words[words > 0].tolist():
        if (hit := places.get(w)) is not None:
            met = row & hit
            row = ((row + met) | (row - met)) & full
    return len(query) - bin(row).count("1")


def _verdict(query: np.ndarray, words: np.ndarray, answer: np.ndarray) -> tuple[int, str | None]:
    """Words of the query that the passage keeps in order, and whether it is a copy, a paraphrase or neither."""
    common = subsequence(query, words)
    if len(query) < SHORTEST:
        windows = np.lib.stride_tricks.sliding_window_view(words, len(query)) if len(words) >= len(query) else words[:0, None]
        return common, "copy" if len(query) and (windows == query).all(1).any() else None
    if common >= COPY * len(query):
        return common, "copy"
    if common >= PARAPHRASE * len(query) and len(words) >= len(answer):
        if (np.lib.stride_tricks.sliding_window_view(words, len(answer)) == answer).all(1).any():
            return common, "paraphrase"
    return common, None


def _leaks(encoded: DataFrame, queries: Queries, idf: np.ndarray, space: np.ndarray, noise: float) -> DataFrame:
    """``noise`` is the mean squared length of a window's TF-IDF vector: what else lies beside a copy."""
    latent, enough = np.zeros((len(queries.codes), space.shape[1])), np.zeros(len(queries.codes), np.float32)
    for i, codes in enumerate(queries.codes):
        t, times = np.unique(codes - 1, return_counts=True)
        latent[i] = (times * idf[t]) @ space[t]
        square = ((times * idf[t]) ** 2).sum()
        # Where the space holds little of a query, its cosine says less and has to reach less.
        held = np.sqrt((latent[i] ** 2).sum() / max(square, 1e-12))
        enough[i] = min(COSINE, PART * np.sqrt(square / max(square + noise, 1e-12))) * min(1, max(LEAST, 2 * held))
    length = np.sqrt((latent * latent).sum(1))
    latent = (latent / np.maximum(length, 1e-12)[:, None]).astype(np.float32)
    # A query of common or unseen terms alone has no place in the space: it meets each passage with one of its terms.
    blind = np.flatnonzero(length < 1e-9)
    enough[blind] = 2
    weighted = (idf[:, None] * space).astype(np.float32)
    # A hit keeps PARAPHRASE of a query's words at least: so many of its different words have to be there at all.
    different = [np.unique(c) for c in queries.codes]
    least = np.array([int(np.ceil(min(PARAPHRASE, COPY) * len(c))) - (len(c) - len(d)) for c, d in zip(queries.codes, different)])
    asked = _term_bits(np.repeat(np.arange(len(different)), [len(d) for d in different]), np.concatenate(different) - 1, len(different), len(idf))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], tuple[float, int, int, str, int]] = {}
            for rows, held, first, (passage, term) in _passages(batch.column(1), 400_000):
                vectors = np.zeros((first[-1] + 1, space.shape[1]), np.float32)
                some = idf[term] > 0
                p, t = passage[some], term[some]
                if len(p):
                    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                    vectors[p[starts]] = np.add.reduceat(weighted[t], starts)
                vectors[:-1] += vectors[1:]
                size = np.maximum(np.sqrt((vectors * vectors).sum(1)), 1e-12)
                bits = _term_bits(passage, term, int(first[-1]) + 1, len(idf))
                # What the window of two passages and one more on each side holds: a query lies in it as a whole.
                wide = bits.copy()
                wide[1:] |= bits[:-1]
                wide[:-1] |= bits[1:]
                wide[:-2] |= bits[2:]
                bits = wide
                for at in range(0, len(latent), 1000):
                    cosine = vectors @ latent[at : at + 1000].T / size[:, None]
                    near, query = np.nonzero(cosine >= enough[at : at + 1000])
                    cosine, query = cosine[near, query], query + at
                    some = _shared(bits, near, asked, query) >= least[query]
                    near, query, cosine = near[some], query[some], cosine[some]
                    _check(found, rows, held, first, near, query, cosine)
                for q in blind:
                    hit = np.unique(passage[np.isin(term, queries.codes[q] - 1)])
                    _check(found, rows, held, first, hit, np.full(len(hit), q), np.zeros(len(hit)))
            keys = sorted(found)
            cosine, common, words, kind, start = ([found[k][c] for k in keys] for c in range(5))
            ids = batch.column(0).to_pylist()
            yield pa.record_batch(
                [
                    pa.array([ids[i] for i, _ in keys], pa.int64()), pa.array([queries.item[q] for _, q in keys], pa.int64()),
                    pa.array(cosine, pa.float64()), pa.array(common, pa.int64()), pa.array(words, pa.int64()),
                    pa.array(kind, pa.string()), pa.array(start, pa.int64()),
                ],
                ["doc_id", "item_id", "cosine", "common_words", "query_words", "kind", "first_word"],
            )

    def _check(found, rows, held, first, near, query, cosine) -> None:
        doc = np.searchsorted(first, near, "right") - 1
        inside = doc < len(held)
        near, query, cosine, doc = near[inside], query[inside], cosine[inside], doc[inside]
        for d, w, q, c in zip(doc.tolist(), near.tolist(), query.tolist(), cosine.tolist()):
            old = found.get((rows[d], q))
            if old is not None and old[1] == old[2]:
                continue
            start = max(0, w - int(first[d]) - 1) * PASSAGE
            words = held[d][start : (w - int(first[d]) + 3) * PASSAGE].astype(np.int64)
            codes = queries.codes[q]
            common, kind = _verdict(codes, words, codes[-ANSWER:])
            if kind is not None and (old is None or common > old[1]):
                found[rows[d], q] = (c, common, len(codes), kind, start)

    schema = "doc_id bigint, item_id bigint, cosine double, common_words bigint, query_words bigint, kind string, first_word bigint"
    return encoded.mapInArrow(search, schema)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, kind, cosine, common_words, query_words, first_word)``: benchmark texts found in documents.

    Benchmark texts are the stated queries, searched for in blocks, against every passage of every
    document. Candidates are windows of two passages whose latent cosine reaches the query's bound; a hit
    keeps ``COPY`` of the query's words in order, or ``PARAPHRASE`` of them with its last words (the
    answer) in one piece. Texts are compared as lower-cased words without punctuation. Of several
    hits of one item in one document the best is returned. Null and blank texts and items hit
    nothing; repeated rows add nothing; empty tables give an empty result; extra columns are ignored.
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = sorted(items.distinct().toLocalIterator(), key=lambda r: (r["item_id"], r["text"]))
    out = None
    for at in range(0, max(1, len(items)), ITEMS_AT_ONCE):
        queries = _queries(items[at : at + ITEMS_AT_ONCE])
        if not queries.codes:
            continue
        encoded = saved(_encoded(docs, queries), "encoded")
        seen, passages = _frequencies(encoded, len(queries.terms))
        idf = np.where((seen > 0) & (seen <= max(COMMON * passages, ALWAYS_RARE)), np.log((1 + passages) / (1 + seen)), 0.0)
        found = _leaks(encoded, queries, idf, latent_space(encoded, idf), 2 * float((seen * idf**2).sum()) / max(passages, 1))
        out = found if out is None else out.union(found)
    if out is None:
        out = docs.sparkSession.createDataFrame(
            [], "doc_id bigint, item_id bigint, cosine double, common_words bigint, query_words bigint, kind string, first_word bigint"
        )
    best = F.max(F.struct("common_words", "cosine", "query_words", "kind", "first_word")).alias("best")
    return out.where("doc_id is not null").groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.kind", "best.cosine", "best.common_words", "best.query_words", "best.first_word"
    )
