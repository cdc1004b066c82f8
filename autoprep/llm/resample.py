"""Quality selection by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.quantiles import exact_quantiles
from .arrays import summed_array
from .shared import saved
from .words import chain, fold_table, hashed_words, mix, sliced

#: Buckets of the hashed words, and as many of the hashed word pairs.
BUCKETS = 1 << 19
#: Labelled documents that the target model and its cutoff learn from, at most.
LABELS = 40_000
#: Pseudo-counts that pull a bucket's ratio towards one, and the log ratio below which it counts against a text.
PRIOR, SLACK = 1.0, 1.0
#: n-grams of the standard text at which log weights of texts of all lengths are compared.
STANDARD = 1000
KEYED = (StructField("doc_id", LongType()), StructField("n_grams", LongType()), StructField("log_weight", DoubleType()), StructField("role", IntegerType()))


def _features(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and bucket of every word and word pair."""
    for owner, h, _ in hashed_words(texts):
        same = owner[1:] == owner[:-1]
        words = (mix(h) % np.uint64(BUCKETS)).astype(np.int64)
        pairs = (chain(h[:-1], h[1:])[same] % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS
        yield np.concatenate([owner, owner[1:][same]]), np.concatenate([words, pairs])


def label_sample(labels: DataFrame, limit: int = LABELS) -> dict[int, int]:
    """``{doc_id: role}`` of at most ``limit`` labelled documents: 1 fits the target, 2 a good and 3 a bad one for the cutoff.

    Good is well written and not toxic; a document labelled twice is good if all its labels are. A
    fifth of the sample, chosen by hash, is kept for the cutoff; bad documents serve only there.
    """
    good = F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"))
    rows = labels.where("doc_id is not null").groupBy("doc_id").agg(good.alias("good")).where("good is not null")
    rows = rows.withColumn("h", F.xxhash64(F.lit("sample"), "doc_id")).orderBy("h", "doc_id").limit(limit).collect()
    return {r["doc_id"]: (3 if not r["good"] else 2 if r["h"] % 5 == 0 else 1) for r in rows}


@dataclass
class Models:
    """Bucket counts of raw and target text, and the target's share of the n-grams of each kind."""

    raw: np.ndarray
    target: np.ndarray
    share: tuple[float, float]


def count_models(docs: DataFrame, roles: dict[int, int]) -> Models:
    """Count all documents into the raw model and those of role 1 into the target model.

    Only the summed buckets, whose number is fixed, reach the driver.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(roles)
    fold = fold_table()

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        both = np.zeros((2, 2 * BUCKETS))
        for batch in sliced(batches):
            fits = np.array([known.value.get(i) == 1 for i in batch.column(0).to_pylist()], bool)
            for owner, bucket in _features([(t or "").encode().translate(fold) for t in batch.column(1).to_pylist()]):
                both[0] += np.bincount(bucket, minlength=2 * BUCKETS)
                both[1] += np.bincount(bucket[fits[owner]], minlength=2 * BUCKETS)
        return both.ravel()

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    raw, target = summed_array(texts, 4 * BUCKETS, count).reshape(2, -1)
    share = tuple(float(target[s].sum() / max(1.0, raw[s].sum())) for s in (slice(0, BUCKETS), slice(BUCKETS, None)))
    return Models(raw.astype(np.float32), target.astype(np.float32), share)


def weighed(docs: DataFrame, models: Models, roles: dict[int, int]) -> DataFrame:
    """``(row, doc_id, n_grams, log_weight, role)``: each row and the target's likelihood over the raw model's, for a standard length.

    Both models leave the scored document out, so its own rare words speak neither for nor against
    it. Per n-gram, ratios are truncated from above: text that is likelier in the target than in the
    raw text gains nothing, so a long clean part cannot outweigh a foul one. Null, empty and blank
    texts weigh 0.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((models, roles))
    fold, docs_columns = fold_table(), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value
        for batch in sliced(batches):
            rows = batch.column(0)
            ids, texts = (rows.field(docs_columns.index(c)).cast(kind) for c, kind in (("doc_id", pa.int64()), ("text", pa.string())))
            role = np.array([known.get(i, 0) for i in ids.to_pylist()], np.int32)
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for owner, bucket in _features([(t or "").encode().translate(fold) for t in texts.to_pylist()]):
                both, times = np.unique(owner.astype(np.int64) * (2 * BUCKETS) + bucket, return_counts=True)
                owner, bucket = both // (2 * BUCKETS), both % (2 * BUCKETS)
                share = np.where(bucket < BUCKETS, *m.share)
                raw = np.maximum(m.raw[bucket] - times, 0)
                target = np.maximum(m.target[bucket] - np.where(role[owner] == 1, times, 0), 0)
                ratio = np.log((target + PRIOR) / (raw * share + PRIOR))
                total += np.bincount(owner, times * np.minimum(ratio + SLACK, 0), batch.num_rows)
                n += np.bincount(owner, times, batch.num_rows).astype(np.int64)
            weight = STANDARD * total / (n + 1)
            out = [rows, ids, pa.array(n), pa.array(weight), pa.array(role)]
            yield pa.record_batch(out, ["row", "doc_id", "n_grams", "log_weight", "role"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, StructType([rows.schema["row"], *KEYED]))


def log_weights(docs: DataFrame, models: Models, roles: dict[int, int]) -> DataFrame:
    """``weighed`` without the rows."""
    return weighed(docs.select("doc_id", "text"), models, roles).drop("row")


def cutoff(scored: DataFrame) -> float:
    """The log weight that best separates good from bad in the sample's held-out part; minus infinity if one is missing."""
    rows = scored.where("role in (2, 3)").groupBy("role", "log_weight").agg(F.count("*").alias("n")).collect()
    values = np.array([r["log_weight"] for r in rows])
    good = np.array([r["n"] if r["role"] == 2 else 0 for r in rows], float)
    bad = np.array([r["n"] if r["role"] == 3 else 0 for r in rows], float)
    if not good.sum() or not bad.sum():
        return -np.inf
    order = np.argsort(values)
    values, good, bad = values[order], good[order] / good.sum(), bad[order] / bad.sum()
    first = np.r_[True, values[1:] > values[:-1]]
    rate = (1 - np.cumsum(good) + good) + (np.cumsum(bad) - bad)
    best = int(np.argmax(np.where(first, rate, -1)))
    return float(values[best] if best == 0 else (values[best] + values[best - 1]) / 2)


def resampled_rows(docs: DataFrame, labels: DataFrame, keep: int | None = None, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that ``resampled`` draws. Each row is judged by itself, so no text is shuffled."""
    return _drawn(docs, labels, keep, seed)[1].select("row.*")


def resampled(docs: DataFrame, labels: DataFrame, keep: int | None = None, seed: int = 42) -> DataFrame:
    """``(doc_id, n_grams, log_weight, sample_key)`` of the Gumbel top-``keep`` documents.

    ``sample_key`` is the log weight plus Gumbel noise drawn from a hash of the id; taking the
    largest keys draws without replacement in proportion to the weights. Without ``keep`` as many
    are drawn as reach the cutoff learnt from the labels. Rows of one id and text share a key and
    are kept together, so ties can only add rows. A null id is a key of its own value. Without
    usable labels nothing is rejected; an empty table gives an empty result.
    """
    return _drawn(docs, labels, keep, seed)[0].select("doc_id", "n_grams", "log_weight", "sample_key")


def _drawn(docs: DataFrame, labels: DataFrame, keep: int | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sample's weights as written, and the sample's rows weighed anew."""
    roles = label_sample(labels)
    models = count_models(docs, roles)
    scored = saved(log_weights(docs, models, roles), "log-weights")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    key = F.col("log_weight") - F.log(-F.log(uniform))
    both = [scored.withColumn("sample_key", key), weighed(docs, models, roles).withColumn("sample_key", key)]
    keyed = both[0]
    least = cutoff(scored)
    counts = keyed.agg(F.count("*").alias("n"), F.count_if(F.col("log_weight") >= least).alias("k")).first()
    n, k = counts["n"], counts["k"] if keep is None else min(keep, counts["n"])
    if k >= n:
        return both[0], both[1]
    if k == 0:
        return both[0].where("false"), both[1].where("false")
    bound = exact_quantiles(keyed, ["sample_key"], [(n - k - 0.5) / (n - 1)])["sample_key"][0] if n > 1 else -np.inf
    return both[0].where(F.col("sample_key") >= bound), both[1].where(F.col("sample_key") >= bound)
