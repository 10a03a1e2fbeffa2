"""Chunk tables of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions.text import content_hash
from tarnlight.functions.vectors import doubles
from tarnlight.shared import spread

CHUNKS = "lookup string, path string, chunk int, hash string, embedding array<double>, bucket int, text string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes of one chunk: a lookup for each language, a folder for each source."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/notes/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select(F.col("lang").alias("lookup"), path.alias("path"), F.lit(0).alias("chunk"), content_hash(F.col("text")).alias("hash"), "text", "doc_id")


def vector_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that have a vector, with it as array<double>."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), doubles(F.col("embedding")).alias("embedding"), F.col("label").cast("int").alias("label"))
    return notes(spark, sf_dir).join(vectors, "doc_id")


def all_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notes, with a null embedding where they have no vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), doubles(F.col("embedding")).alias("embedding"))
    return spread(notes(spark, sf_dir)).join(vectors, "doc_id", "left")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One stored vector, by a filter that reaches the scan."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(doubles(F.col("embedding")).alias("v")).first()
    if row is None:
        raise ValueError(f"no vector {vec_id}")
    return list(row["v"])
