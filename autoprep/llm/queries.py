"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, hosts, mixing, prefixes, suffixes
from .decontaminate import leaks
from .kneser import score_documents
from .language import identify
from .passages import repeated_spans
from .resample import resampled
from .shared import read_table
from .simhash import simhash_groups
from .vectors import near_vectors
from .wrappers import extract_text


def op1_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op2_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_spans(read_table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "start", "stop", F.col("words").alias("n_words"), F.col("first_doc").alias("kept_doc_id"))


def op3_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge_urls(read_table(spark, sf_dir, "pages"), hosts.outcomes_of(read_table(spark, sf_dir, "labels")))


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read_table(spark, sf_dir, "documents"))


def op7_vector_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))


def op9_simhash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeated_bytes(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_gru": op1_byte_gru,
    "op2_paragraph_minhash": op2_paragraph_minhash,
    "op3_wrapper_text": op3_wrapper_text,
    "op4_host_reputation": op4_host_reputation,
    "op5_latent_decontamination": op5_latent_decontamination,
    "op6_temperature_mixing": op6_temperature_mixing,
    "op7_vector_pigeonhole": op7_vector_pigeonhole,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_simhash_pivot": op9_simhash_pivot,
    "op10_importance_resampling": op10_importance_resampling,
    "op11_stripes": op11_stripes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_suffix_array": op13_suffix_array,
}

ORACLES: dict[str, str] = {
    "op4_host_reputation": hosts.oracle(),
    "op6_temperature_mixing": mixing.oracle(),
    "op11_stripes": collocations.oracle(),
    "op12_prefix_trie": prefixes.oracle(),
    "op13_suffix_array": suffixes.oracle(),
}
