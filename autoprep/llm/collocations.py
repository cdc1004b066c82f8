"""Phrase mining by stripes: each prefix keys an associative counter of the words that follow it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packed import groups, numbers, planes
from .shared import saved
from .words import chain, hash_spans, mix, word_spans

#: Longest phrase in words, and least occurrences of a candidate.
WORDS, LEAST = 4, 30
#: Bytes of text that are counted together, and counters that a task merges before it sends them.
SLICE, HELD = 2 << 20, 1 << 21
#: A stripe is dealt into so many parts by its next words.
PARTS = 16
#: Bits of the filter of word pairs: one bucket for so many bytes of text, within these bounds.
BYTES_A_BUCKET, FEWEST, MOST = 64, 16, 26
#: Buckets of the filter that are summed as one row.
BLOCK, SALTS = 1 << 18, 16

#: Exact beyond 64 bits.
SCORE = "cast(cast(a as decimal(24,0)) * 2000000 div (cast(l as decimal(24,0)) + r) as bigint)"

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"


def _fold() -> bytes:
    """A-Z to lower case, tabs to spaces, and all separators of pieces to line feeds."""
    table = bytearray(range(256))
    for b in range(ord("A"), ord("Z") + 1):
        table[b] = b + 32
    table[9] = 32
    for b in _SEPARATORS:
        table[b] = 10
    return bytes(table)


class _Slice:
    """Words of texts of one language: their hashes, and how many words of the same piece follow each."""

    def __init__(self, parts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(parts), np.uint8)
        line = self.data == 10
        self.starts, self.ends = word_spans(np.where(line, 32, self.data).astype(np.uint8))
        self.words = hash_spans(self.data, self.starts, self.ends)
        piece = np.cumsum(line)[self.starts] if len(self.starts) else self.starts
        # Words up to the end of the piece, the word itself included.
        last = np.searchsorted(piece, piece, "right")
        self.room = last - np.arange(len(piece))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Slice]]:
    """Texts by language, about ``SLICE`` bytes together; a longer text is cut where a piece ends."""
    fold = _fold()
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data, at = text.encode().translate(fold), 0
            while at < len(data):
                end = data.find(b"\n", at + SLICE)
                end = len(data) if end < 0 else end
                held.setdefault(lang, []).append(data[at:end])
                size[lang] = size.get(lang, 0) + end - at
                at = end
                if size[lang] >= SLICE:
                    yield lang, _Slice(held.pop(lang))
                    size[lang] = 0
    for lang, parts in held.items():
        yield lang, _Slice(parts)


def _language(lang: str) -> np.ndarray:
    """The key of a language's empty prefix, as an array of one."""
    data = np.frombuffer(lang.encode() + b"\n", np.uint8)
    return hash_spans(data, np.array([0]), np.array([len(data)]))


def _pairs(lang: str, part: _Slice) -> np.ndarray:
    """Keys of all two-word phrases."""
    at = np.flatnonzero(part.room >= 2)
    return chain(chain(_language(lang), part.words[at]), part.words[at + 1])


def _filter(docs: DataFrame, bits: int) -> np.ndarray:
    """For each bucket of two-word phrases whether together they occur ``LEAST`` times; a bit each.

    Tasks count into arrays of one byte, sums stop at 255: what can reach ``LEAST`` always does.
    """
    length = 1 << bits
    schema = "block int, salt int, part binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.uint8)
        for lang, part in _slices(batches):
            where, n = np.unique((_pairs(lang, part) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            total[where] = np.minimum(total[where] + n, 255)
        salt = TaskContext.get().partitionId() % SALTS
        for b in range(0, length, BLOCK):
            if total[b : b + BLOCK].any():
                yield pa.record_batch([pa.array([b // BLOCK], pa.int32()), pa.array([salt], pa.int32()), pa.array([total[b : b + BLOCK].tobytes()])], ["block", "salt", "part"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(min(length, BLOCK), np.int64)
        for p in group.column("part"):
            total = np.minimum(total + np.frombuffer(p.as_buffer(), np.uint8), 255)
        return pa.table({"block": group.column("block").slice(0, 1), "salt": group.column("salt").slice(0, 1), "part": [total.astype(np.uint8).tobytes()]})

    def enough(group: pa.Table) -> pa.Table:
        group = add(group)
        return group.set_column(2, "part", [pa.array([np.packbits(np.frombuffer(group.column("part")[0].as_py(), np.uint8) >= LEAST).tobytes()])])

    parts = docs.coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(count, schema)
    out = np.zeros(max(1, length >> 3), np.uint8)
    for r in parts.groupBy("block", "salt").applyInArrow(add, schema).groupBy("block").applyInArrow(enough, schema).collect():
        out[r["block"] * (BLOCK >> 3) :][: len(r["part"])] = np.frombuffer(r["part"], np.uint8)
    return out


def _merged(prefix: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elementwise sum of stripes: counters with equal prefix and next word become one."""
    order = np.lexsort((word, prefix))
    prefix, word, n = prefix[order], word[order], n[order]
    heads = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1])])) if len(prefix) else np.zeros(0, np.int64)
    return prefix[heads], word[heads], np.add.reduceat(n, heads) if len(heads) else n


SENT = "bucket int, lang string, prefixes binary, words binary, counts binary, texts binary"
STRIPES = "lang string, prefix bigint, word bigint, key bigint, text string, n bigint"


def stripes(docs: DataFrame) -> DataFrame:
    """``(lang, prefix, word, key, text, n)``: counters of at least ``LEAST``, and each language's total (no word).

    The prefix of no word keys the words of a language, with their text; a longer prefix, known by its
    key, counts the words that follow it. ``key`` is the prefix that the counter's phrase makes.
    Counters of phrases that cannot occur ``LEAST`` times, by the filter of word pairs, stay at home;
    a stripe is dealt into ``PARTS`` by next word, so that of a very frequent prefix is not one task's.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST, max(FEWEST, int(size // BYTES_A_BUCKET).bit_length()))
    passing = _filter(docs, bits)
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def passes(keys: np.ndarray) -> np.ndarray:
        at = (keys >> np.uint64(64 - bits)).astype(np.int64)
        return (passing[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0

    def dealt(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
        return ((mix(prefix ^ (word % np.uint64(PARTS))) >> np.uint64(32)).astype(np.int64) * buckets >> 32).astype(np.int32)

    def cut(bucket: np.ndarray) -> list[tuple[int, int]]:
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        return [(int(p), int(q)) for p, q in zip(edges, edges[1:]) if q > p]

    def record(bucket: np.ndarray, lang: str | None, columns: list[list[bytes | None]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(bucket), pa.array([lang] * len(bucket), pa.string()), *[pa.array(c, pa.binary()) for c in columns]], [x.split()[0] for x in SENT.split(", ")])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for lang, part in _slices(batches):
            # The stripe of the empty prefix: words, with their text.
            word, first, n = np.unique(part.words, return_index=True, return_counts=True)
            bucket = dealt(np.full(len(word), _language(lang)), word)
            order = np.argsort(bucket, kind="stable")
            whole, spans = part.data.tobytes(), cut(bucket[order])
            text = [whole[a:b] for a, b in zip(part.starts[first[order]].tolist(), part.ends[first[order]].tolist())]
            word, n = word[order], n[order]
            yield record(
                bucket[order][[p for p, _ in spans]], lang,
                [[None] * len(spans), [planes(word[p:q]) for p, q in spans], [planes(n[p:q]) for p, q in spans], [b"\n".join(text[p:q]) for p, q in spans]],
            )
            # Longer prefixes, as long as all pairs in the phrase pass.
            key = chain(_language(lang), part.words)
            good = np.zeros(len(key), bool)
            two = np.flatnonzero(part.room >= 2)
            good[two] = passes(chain(key[two], part.words[two + 1]))
            at, prefix = np.arange(len(key)), key
            for m in range(1, WORDS):
                keep = (part.room[at] > m) & good[np.minimum(at + m - 1, len(key) - 1)]
                at, prefix = at[keep], prefix[keep]
                follower = part.words[at + m]
                held.append(_merged(prefix, follower, np.ones(len(at), np.int64)))
                prefix = chain(prefix, follower)
            if sum(len(x[0]) for x in held) >= HELD:
                yield from flushed(held)
                held = []
        yield from flushed(held)

    def flushed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if held:
            prefix, word, n = _merged(*(np.concatenate(c) for c in zip(*held)))
            bucket = dealt(prefix, word)
            order = np.argsort(bucket, kind="stable")
            spans = cut(bucket[order])
            packs = [[planes(x[order[p:q]]) for p, q in spans] for x in (prefix, word, n)]
            yield record(bucket[order][[p for p, _ in spans]], None, [*packs, [None] * len(spans)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STRIPES.split(", ")]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        for _, table in groups(batches):
            named, longer = {}, []
            for lang, prefix, word, n, text in zip(*(table[c].to_pylist() for c in ("lang", "prefixes", "words", "counts", "texts"))):
                if lang is None:
                    longer.append((prefix, word, n))
                else:
                    named.setdefault(lang, []).append((word, n, text))
            for lang, rows in named.items():
                word, n = numbers([r[0] for r in rows], "u8"), numbers([r[1] for r in rows], "i8")
                text = np.array(b"\n".join(r[2] for r in rows).split(b"\n"), object)
                word, first, which = np.unique(word, return_index=True, return_inverse=True)
                by = np.argsort(which, kind="stable")
                n = np.add.reduceat(n[by], np.searchsorted(which[by], np.arange(len(word))))
                often = np.flatnonzero(n >= LEAST)
                key = chain(_language(lang), word[often])
                out = [[lang] * len(often), np.full(len(often), _language(lang)).view(np.int64), word[often].view(np.int64), key.view(np.int64), [t.decode() for t in text[first[often]]], n[often]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names)
                yield pa.record_batch([pa.array([x], t) for x, t in zip((lang, None, None, None, None, int(n.sum())), kinds)], names)
            if longer:
                prefix, word, n = _merged(*(numbers([r[i] for r in longer], k) for i, k in enumerate(("u8", "u8", "i8"))))
                often = n >= LEAST
                prefix, word, n = prefix[often], word[often], n[often]
                out = [pa.nulls(len(n), pa.string()), *(pa.array(x.view(np.int64)) for x in (prefix, word, chain(prefix, word))), pa.nulls(len(n), pa.string()), pa.array(n)]
                yield pa.record_batch(out, names)

    sent = docs.mapInArrow(send, SENT).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(merge, STRIPES)


def ranked(rows: DataFrame, by: str, order: list, most: int, name: str) -> DataFrame:
    """The first ``most`` rows of each group with their rank: ranks in ranges of the order, then what lies before each range."""
    ranged = saved(rows.repartitionByRange(F.col(by), *order).withColumn("__part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(by, "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    sizes = sizes.where(F.col("__before") < most).select(by, "__part", "__before")
    inside = F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order))
    out = ranged.join(sizes, [by, "__part"]).withColumn(name, (inside + F.col("__before")).cast("bigint"))
    return out.where(F.col(name) <= most).drop("__part", "__before")


def phrases(docs: DataFrame) -> DataFrame:
    """Frequent phrases of 1 to ``WORDS`` words: ``(lang, phrase, words, f, n)``, n being the words of the language."""
    found = saved(stripes(docs), "stripes")
    words = found.where("text is not null").select("lang", "word", "key", F.col("text").alias("phrase"), F.array("text").alias("words"), F.col("n").alias("f"))
    longer = found.where("lang is null").select("prefix", F.col("word").alias("follower"), "key", F.col("n").alias("f"))
    names = words.select(F.col("lang").alias("l"), F.col("word").alias("follower"), F.col("phrase").alias("text"))
    out, shorter = [words.select("lang", "phrase", "words", "f")], words.select("lang", F.col("key").alias("prefix"), "words")
    for _ in range(1, WORDS):
        grown = longer.join(shorter, "prefix").join(names, "follower").where("lang = l")
        grown = saved(grown.select("lang", "key", F.concat("words", F.array("text")).alias("words"), "f"), "phrases")
        out.append(grown.select("lang", F.array_join("words", " ").alias("phrase"), "words", "f"))
        shorter = grown.select("lang", F.col("key").alias("prefix"), "words")
    total = found.where("lang is not null and text is null").groupBy("lang").agg(F.sum("n").alias("n"))
    return reduce(DataFrame.unionByName, out).join(total, "lang")


def collocations(docs: DataFrame, most: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and into words at spaces
    and tabs. n counts the words of a language, a, l and r the occurrences of a phrase and of its two
    parts where it is cut; the score is 2000000 * a / (l + r), rounded down, at the worst cut (of equal
    ones that with the shortest first part). Phrases that lie in a longer one with at least 80 % of
    their occurrences are dropped; a frequent longer phrase that holds a phrase holds one that is one
    word longer, so the largest counter of one more word on either side decides. The first ``most`` of
    each language by score, occurrences and phrase are returned.

    A null language is ``und``, a null text empty; repeated rows count as often as they come; no
    words give no rows; texts of any length are cut where pieces end; extra columns are ignored.
    Phrases are told apart by 64 bits for the prefix and 64 for the next word.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    known = saved(phrases(docs), "known")
    size = F.size("words")
    candidates = known.where(size > 1)
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.array_join(F.slice("words", F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("rest", F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " "))
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(count)), ["lang", part])
    worst = F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("worst")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(worst).select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
    longer = candidates.where(size > 2)
    left, right = F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1)
    held = longer.select("lang", F.array_join(left, " ").alias("phrase"), "f").unionByName(longer.select("lang", F.array_join(right, " ").alias("phrase"), "f"))
    held = held.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = scored.join(held, ["lang", "phrase"], "left")
    kept = kept.where("held is null or cast(held as decimal(24,0)) * 100 < cast(a as decimal(24,0)) * 80").drop("held")
    best = ranked(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], most, "rank")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(most: int = 2000) -> str:
    """DuckDB SQL for the same rows, from the occurrences themselves."""
    first = [", ".join(f"w{j}" for j in range(1, m + 1)) for m in range(WORDS + 1)]
    grams = " union all ".join(f"select lang, [{first[m]}] as ws, count(*) as f from steps where w{m} is not null group by lang, {first[m]}" for m in range(1, WORDS + 1))
    return f"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
lists as (select lang, row_number() over () as id, regexp_extract_all(piece, '[^ \\t]+') as ws from pieces),
placed as (select lang, id, unnest(ws) as w1, generate_subscripts(ws, 1) as i from lists),
steps as (select lang, w1, {", ".join(f"lead(w1, {j}) over p as w{j + 1}" for j in range(1, WORDS))} from placed window p as (partition by id order by i)),
total as (select lang, count(*) as n from placed group by lang),
grams as (select * from ({grams}) where f >= {LEAST}),
cuts as (select c.lang, c.ws, c.f as a, x.k, x.l, x.r, 2000000::hugeint * c.f // (x.l + x.r) as score from grams c,
         lateral (select k, (select f from grams g where g.lang = c.lang and g.ws = c.ws[:k]) as l, (select f from grams g where g.lang = c.lang and g.ws = c.ws[k + 1:]) as r
                  from range(1, len(c.ws)) t(k)) x where len(c.ws) > 1),
worst as (select *, row_number() over (partition by lang, ws order by score, k) as nth from cuts),
held as (select lang, ws[a:b] as sub, max(f) as f from grams, range(1, {WORDS}) x(a), range(2, {WORDS + 1}) y(b) where a < b and b <= len(ws) and b - a + 1 < len(ws) group by all)
select w.lang, row_number() over (partition by w.lang order by score desc, a desc, array_to_string(w.ws, ' ')) as rank, array_to_string(w.ws, ' ') as phrase, a, l, r, n, score::bigint as score
from worst w join total using (lang) left join held h on h.lang = w.lang and h.sub = w.ws
where nth = 1 and not coalesce(100::hugeint * h.f >= 80::hugeint * a, false)
qualify rank <= {most}"""
