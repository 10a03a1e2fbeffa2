"""Corpus pipeline: language ID, near duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlight.llm.language import identified
from tarnlight.llm.near_duplicates import keep_one
from tarnlight.llm.packing import packed
from tarnlight.llm.pii import pseudonymised
from tarnlight.llm.substrings import deduplicated
from tarnlight.shared import ARROW_ROWS, BATCH_ROWS, spread, written


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in most stages: Arrow batches of BATCH_ROWS rows from here on, in this session."""
    spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    small_batches(spark)
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    small_batches(spark)
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that another one has already."""
    small_batches(spark)
    return deduplicated(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in the place of personal data."""
    small_batches(spark)
    return pseudonymised(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of documents for training."""
    small_batches(spark)
    return packed(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("PII", pii),
    ("packing", packing),
]
#: None of the stages but the first join can be said in SQL; the tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each written as Parquet and read again; gives the windows of the last."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
