"""Canonical rows of the domain tables: one row a key, the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.context import read
from folioflow.operators.incremental import latest


def blocks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(doc_id, id, columns...) of the last ingested row of each block."""
    return latest(read(spark, sf_dir, "blocks"), ["doc_id", "id"], ["ingested_at"], list(columns))


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(doc_id, chunk_id, columns...) of each chunk's greatest revision."""
    return latest(read(spark, sf_dir, "chunks"), ["doc_id", "chunk_id"], ["revision", "arrived_at"], list(columns or ("ord", "source", "output")))


def run_state(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(doc_id, chunk_id, columns...) of each chunk's last committed run."""
    return latest(read(spark, sf_dir, "run_state").where(F.col("status") == "committed"), ["doc_id", "chunk_id"], ["run_no", "updated_at"], list(columns))


def manifest(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(doc_id, columns...) of each book's greatest revision."""
    return latest(read(spark, sf_dir, "manifest"), ["doc_id"], ["revision", "created_at"], list(columns))


def marked_files(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, is_output, text) of ``chunkNNNN.md`` and ``output_chunkNNNN.md`` under a path;
    text is null where the bytes are no UTF-8."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    chunk = F.regexp_extract(name, r"^(?:output_)?(chunk\d+)\.md$", 1)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(chunk.alias("chunk_id"), name.startswith("output_").alias("is_output"), text.alias("text")).where("chunk_id <> ''")
