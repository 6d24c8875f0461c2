"""Files similar to a file, and distinct paths of hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdex.operators.search import vector_search


def best_per_file(hits: DataFrame, own_path: str | None, limit: int) -> DataFrame:
    """Each file's best score, the own file left out, best first."""
    others = hits if own_path is None else hits.where(F.col("file_path") != own_path)
    return others.groupBy("file_path").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "file_path").limit(limit)


def similar_files(chunks: DataFrame, query: Sequence[float], own_path: str, fetch: int = 20, limit: int = 10) -> DataFrame:
    """Files of the ``fetch`` best chunks with a score of at least zero. The file's own chunks go before the top k, so a long
    file does not starve its own result."""
    return best_per_file(vector_search(chunks.where(F.col("file_path") != own_path), query, fetch, 0.0), None, limit)


def distinct_paths(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """Paths of ranked hits, each at its best place."""
    return hits.groupBy("file_path").agg(F.min(rank).alias("first_rank")).orderBy("first_rank", "file_path")
