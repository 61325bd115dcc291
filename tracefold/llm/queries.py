"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, exact_dedup, flac, fuzzy_lines, kd_shards, language, middle, mixing, periodic, secrets, sentence_pieces, simhash, toxicity
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("bucket")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.fuzzy_lines(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.features(flac.store(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = middle.restored(middle.fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    return sentence_pieces.digests(sentence_pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(model)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(periodic.looped(table(spark, sf_dir, "documents"))).drop("runs")


_OPERATORS = (
    op1_exact_dedup, op2_language, op3_secrets, op4_kd_shards, op5_byte_bpe, op6_fuzzy_lines, op7_toxicity, op8_flac, op9_mixing, op10_simhash,
    op11_fill_in_middle, op12_sentence_pieces, op13_periodic_runs,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES = {"op1_exact_dedup": exact_dedup.ORACLE, "op11_fill_in_middle": middle.ORACLE}
