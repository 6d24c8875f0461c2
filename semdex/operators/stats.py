"""Index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS_PER_CHUNK = 256


def stats(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: file_count, chunk_count, estimated_tokens and last_indexed (the latest file time)."""
    files = manifest.agg(F.count(F.lit(1)).alias("file_count"), F.max("modified_at").alias("last_indexed"))
    rows = chunks.agg(F.count(F.lit(1)).alias("chunk_count"))
    return files.join(rows, F.lit(True)).select(
        "file_count", "chunk_count", (F.col("chunk_count") * TOKENS_PER_CHUNK).alias("estimated_tokens"), "last_indexed"
    )


def refreshed_files(new_chunks: DataFrame) -> DataFrame:
    """How many files got chunks."""
    return new_chunks.agg(F.countDistinct("file_path").alias("refreshed"))


def files_by_index(manifests: DataFrame) -> DataFrame:
    """Files of each index of a table with an index column."""
    return manifests.groupBy("index").agg(F.count(F.lit(1)).alias("files"))
