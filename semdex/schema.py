"""Row types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: A stored chunk. vector items are floats; arithmetic on them is in doubles. mtime lets the date filter reach the scan.
CHUNKS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType(), True), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("chunk_index", T.LongType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("context", T.StringType(), False),
        T.StructField("token_count", T.LongType(), False),
        T.StructField("mtime", T.TimestampType(), True),
    ]
)

#: The manifest: a row per indexed file, with the ids of its chunks.
MANIFEST = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("modified_ns", T.LongType(), False),
        T.StructField("modified_at", T.TimestampType(), False),
        T.StructField("chunk_ids", T.ArrayType(T.StringType()), False),
    ]
)

#: The manifest as stored, with the part of the index that holds a file's chunks.
PLACED = T.StructType([*MANIFEST.fields, T.StructField("part", T.StringType(), False)])

#: A crawled file before and after reading.
FILES = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("modified_ns", T.LongType(), False),
        T.StructField("size", T.LongType(), False),
    ]
)
TEXTS = T.StructType([*FILES.fields, T.StructField("text", T.StringType(), True), T.StructField("problem", T.StringType(), True)])

#: A manifest in its JSON form, as other tools keep it.
MANIFEST_JSON = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField(
            "files",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField(
                            "modified_at",
                            T.StructType([T.StructField("secs_since_epoch", T.LongType()), T.StructField("nanos_since_epoch", T.LongType())]),
                        ),
                        T.StructField("chunk_ids", T.ArrayType(T.StringType())),
                    ]
                ),
            ),
        ),
    ]
)
