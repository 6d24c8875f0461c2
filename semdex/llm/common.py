"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). A temporary one stands in only on a local master, where one
    process has all tasks; on a cluster an unset folder is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="semdex-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back.

    Later jobs reread committed files, so a lost executor costs no recomputation of what led here. The table goes with release(),
    or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/semdex/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, folder = _folder(spark, path)
    system.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing lazy reads any more."""
    system, folder = _folder(df.sparkSession, df.written_to)
    system.delete(folder, True)


#: Bytes of an Arrow batch of texts; Spark's default is sixteen times this, in both processes and for each running task.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session set to send Python workers Arrow batches of at most BATCH_BYTES; a smaller setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(conf.get(key).rstrip("b")) > BATCH_BYTES:
            conf.set(key, str(BATCH_BYTES))
    except ValueError:
        pass  # a value with a unit is the user's own
    return df


def sliced(batches: Iterator, rows: int = 1000) -> Iterator:
    """Arrow batches or pandas frames in parts of at most so many rows, so that Python objects of a few are alive at once."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.iloc[k : k + rows] if hasattr(batch, "iloc") else batch.slice(k, rows)


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null, empty or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")
