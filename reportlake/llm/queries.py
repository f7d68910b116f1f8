"""The queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportlake.llm import decontaminate, embedding_index, language_id, license_scan, minhash, mixing, secret_scan, substring_dedup, suffix_family, token_shards
from reportlake.llm.oracle import ORACLE_SQL
from reportlake.llm.shared import scratch_path

__all__ = ["ORACLE_SQL", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages together: both give evidence, both get a language."""
    documents, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    evidence = language_id.evidence_of_documents(documents).unionByName(language_id.evidence_of_pages(pages))
    return language_id.identify(evidence, language_id.fit_documents(documents)).drop("key")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_family.remove_earlier(_table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.mark(_table(spark, sf_dir, "documents"))


def op8_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_index.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_shards.write_shards(_table(spark, sf_dir, "documents"), scratch_path(spark, "shards"))
    return token_shards.index_of(shards)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_license_scan": op5_license_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_repeated_windows": op8_repeated_windows,
    "op9_near_vectors": op9_near_vectors,
    "op10_token_shards": op10_token_shards,
    "pipeline": pipeline,
}
