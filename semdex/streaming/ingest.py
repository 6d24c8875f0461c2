"""Append-only ingestion: chunk and embed documents as they land in a folder, in micro-batches.

For drops that only grow. A file rewritten at its path is not seen again by the file source; Indexer.refresh is for those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from semdex.config import Config
from semdex.functions.embedding import Embedder
from semdex.functions.text import chunk_id, embedded_text
from semdex.operators.chunking import chunked

DOCUMENTS = "file_path string, text string"


def chunk_stream(documents: DataFrame, config: Config, embedder: Embedder) -> DataFrame:
    """Chunks with vectors of a stream of documents (file_path, text); no state is kept between batches."""
    cut = chunked(documents, config.chunking).withColumn("context", F.lit(""))
    vectors = embedder.column(cut, embedded_text(F.col("context"), F.col("content")), "vector")
    return vectors.withColumn("id", chunk_id(F.col("file_path"), F.col("chunk_index"), F.col("content")))


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, config: Config, embedder: Embedder) -> StreamingQuery:
    """Take all Parquet documents that arrived since the last run; the checkpoint makes each count once."""
    documents = spark.readStream.schema(DOCUMENTS).parquet(source)
    chunks = chunk_stream(documents, config, embedder)
    return chunks.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
