"""Registered queries of this folder: name -> (Spark callable, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candlewick.llm import compression_quality, decontaminate, embedding_dedup, hard_negatives, jaccard_join, license_scan, mixing, oracles, periodic_runs, piece_sampling, robust_outliers, secret_scan, substring_dedup, warc_fixity
from candlewick.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_mix_sources")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op2_piece_sampling")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(table(spark, sf_dir, "documents"))


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op4_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.component_table(table(spark, sf_dir, "documents"))


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op7_robust_outliers")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (robust_outliers.verdicts(table(spark, sf_dir, "documents"))
            .select("doc_id", *robust_outliers.COUNTS[:5], "base_failed", "kept", "distance"))


@query("op8_embedding_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op9_warc_fixity", warc_fixity.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_fixity.audit(*warc_fixity.page_records(spark, sf_dir))


@query("op10_compression_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_periodic_runs", oracles.PERIODIC_RUNS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"))


@query("op12_hard_negatives", oracles.HARD_NEGATIVES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.shifted(table(spark, sf_dir, "embeddings")))


@query("op13_decontaminate", oracles.DECONTAMINATE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
