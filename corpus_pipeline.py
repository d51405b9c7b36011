"""Corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents.

quality     documents that the compression classifier rejects go
near_dups   one document of each group of linked documents stays
secrets     secrets in the texts are masked
mixture     the texts become the blocks that the mix of sources takes
tokens      every block gets a sampled, lossless segmentation
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlewick.llm import compression_quality, jaccard_join, mixing, piece_sampling, secret_scan
from candlewick.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return compression_quality.keep_good(docs, compression_quality.train(docs, table(spark, sf_dir, "labels")))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.blocks_of(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(docs, keep=("lang", "source"))


STAGES = [("quality", quality), ("near_dups", near_dups), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]

#: sampling, trained models and tokenising have no SQL form; tests check the stages by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
