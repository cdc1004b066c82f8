"""The corpus pipeline: five stages from raw documents to a mixture of sources.

Each stage takes all that its predecessor kept, written as Parquet and read again. Stages decide about
texts: of two texts under one doc_id each has its own fate, equal rows are one document. A null doc_id is
no document and goes with the near copies. Null and empty texts, ties, very long texts and extra columns
are treated as the stages' operators say; extra columns are carried along. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autoprep.llm.decontaminate import leaks
from autoprep.llm.mixing import mixed
from autoprep.llm.passages import without_repeats
from autoprep.llm.resample import resampled_rows
from autoprep.llm.shared import dropped, read_table, saved
from autoprep.llm.simhash import simhash_groups


def _version() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents outside the importance sample go."""
    return resampled_rows(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group the document with the smallest id stays, once if its row repeats.

    Where that id has several texts in the group, the one with the smallest hash stays.
    """
    groups = saved(simhash_groups(docs), "groups").where("doc_id = component_id")
    kept = groups.groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("kept"), F.count("*").alias("n"))
    kept = saved(kept.select("kept.doc_id", F.col("kept.version").alias("__version"), "n"), "kept")
    out = docs.withColumn("__version", _version()).join(kept.drop("n"), ["doc_id", "__version"], "left_semi")
    # Only where a kept row may repeat do the texts have to be shuffled for it.
    out = out if kept.where("n > 1").isEmpty() else out.dropDuplicates(["doc_id", "__version"])
    return out.select(*docs.columns)


def drop_repeated_parts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated paragraphs and passages leave the texts, except in the first place."""
    return without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark text go."""
    keyed = docs.withColumn("__text", F.xxhash64(F.col("doc_id"), _version()))
    found = leaks(keyed.select(F.col("__text").alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    found = saved(found.select(F.col("doc_id").alias("__text")).distinct(), "leaks")
    return keyed.join(found, "__text", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: the rows of the mixture in blocks, each document at least once."""
    return mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_parts),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
]

# The classifier, the fingerprints and the latent search are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
