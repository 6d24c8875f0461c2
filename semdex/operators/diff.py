"""Incremental maintenance as joins: what is new, modified, unchanged or deleted, and the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(crawled: DataFrame, manifest: DataFrame) -> DataFrame:
    """file_path and status. A file is unchanged only if its time equals the recorded one, so a clock set back counts."""
    new = crawled.select("file_path", F.col("modified_ns").alias("now_ns"))
    old = manifest.select("file_path", F.col("modified_ns").alias("old_ns"), F.lit(True).alias("known"))
    new = new.withColumn("there", F.lit(True))
    status = (
        F.when(F.col("known").isNull(), F.lit("new"))
        .when(F.col("there").isNull(), F.lit("deleted"))
        .when(F.col("now_ns").eqNullSafe(F.col("old_ns")), F.lit("unchanged"))
        .otherwise(F.lit("modified"))
    )
    return new.join(old, "file_path", "full_outer").select("file_path", status.alias("status"))


def without_files(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose file_path is not among those gone."""
    return rows.join(gone.select("file_path").distinct(), "file_path", "left_anti")


def apply_delta(chunks: DataFrame, gone: DataFrame, added: DataFrame) -> DataFrame:
    """The next snapshot's chunks: the old ones of files that stay as they are, and the added ones."""
    return without_files(chunks, gone).unionByName(added)
