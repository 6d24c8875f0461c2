"""Views of the test tables in the engine's data model: stored chunks, files, manifests and query vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is read from the files once an application."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(key[1]).schema
    return spark.read.schema(_schemas[key]).parquet(key[1])


def idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks: 50 paths a label, several chunks each."""
    e = table(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("/corpus/l"), F.col("label"), F.lit("/f"), F.col("vec_id") % 50, F.lit(".txt"))
    return e.select("vec_id", path.alias("file_path"), F.expr("vec_id div 50").alias("chunk_index"), F.col("embedding").alias("vector"))


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files: a path, text and source of each document."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return d.select("doc_id", path.alias("file_path"), "text", "lang", "source")


def para(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose lines are blocks."""
    return doc(spark, sf_dir).withColumn("text", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))


def man(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest times by id, with a seventh of the ids missing."""
    e = table(spark, sf_dir, "events")
    return e.where(F.col("event_id") % 7 != 0).select(F.col("event_id").alias("vec_id"), F.col("ts").alias("modified_at"))


def idx_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest row a file: the latest time of its chunks' ids."""
    rows = idx(spark, sf_dir).select("vec_id", "file_path").join(man(spark, sf_dir), "vec_id")
    return rows.groupBy("file_path").agg(F.max("modified_at").alias("modified_at"))


def manifest_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc(spark, sf_dir).where(F.col("doc_id") % 10 != 0)
    return d.select("file_path", (F.col("doc_id") * 1000).alias("modified_ns"))


def manifest_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc(spark, sf_dir).where(F.col("doc_id") % 10 != 1)
    bumped = F.when(F.col("doc_id") % 10 == 2, F.lit(-5)).otherwise(F.lit(0))
    return d.select("file_path", (F.col("doc_id") * 1000 + bumped).alias("modified_ns"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector as a query."""
    return query_row(spark, sf_dir, vec_id)[1]


def query_row(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> tuple[str, list[float]]:
    """Path and vector of one stored chunk."""
    row = idx(spark, sf_dir).where(F.col("vec_id") == vec_id).select("file_path", "vector").head()
    return row["file_path"], list(row["vector"])
