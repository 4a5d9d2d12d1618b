"""The queries of this subpackage: thin applications of its operators to whole tables, as ``name: (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, exact_dedup, language_id, lexical_search, line_dedup, lm_ppm, merkle, packing, quality_knn, quality_rules, secret_scan, simhash, suffix_dedup
from .common import documents, held_out


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_pages(spark, sf_dir))


def op4_lm_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_ppm.ppm_scores(documents(spark, sf_dir), held_out(7, 2), across_words=True)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="max")


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_knn.quality_votes(documents(spark, sf_dir), labels, held_out(5, 0))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(documents(spark, sf_dir))
    return found.withColumn("n_words", F.col("end_word") - F.col("first_word"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(documents(spark, sf_dir), width=3, radius=2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir), held_out(3, 1))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(documents(spark, sf_dir))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OPERATORS = (
    op1_bpe, op2_quality_rules, op3_line_dedup, op4_lm_ppm, op5_best_fit_packing, op6_exact_dedup, op7_quality_knn, op8_suffix_dedup, op9_simhash, op10_language_id, op11_merkle_manifest, op12_secret_scan,
    op13_lexical_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}
