"""The registered queries of these operators: production parameters, whole tables, digest columns only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, minhash_dedup, oracles, packing, pii, quality, sharding, shared, substring_dedup, token_counts, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(_table(spark, sf_dir, "documents"))[1]


def op2_pii_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op4_embedding_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_embeddings(_table(spark, sf_dir, "embeddings"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"))


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.fitted(docs, _table(spark, sf_dir, "labels")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_repeats(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kd_sharding": op1_kd_sharding,
        "op2_pii_semi_crf": op2_pii_semi_crf,
        "op3_token_counts": op3_token_counts,
        "op4_embedding_itq": op4_embedding_itq,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_url_filter": op8_url_filter,
        "op9_quality_crf": op9_quality_crf,
        "op10_substring_dedup": op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
