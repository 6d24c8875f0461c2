"""Exact vector search with path, date and threshold filters, as one lazy plan.

Filters come before the top k, so a filtered search never starves; scores are cosine similarities in double arithmetic; ties
go to the smaller path and chunk index.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from semdex.functions.similarity import comparable, cosine_to, doubles, passes
from semdex.functions.text import path_contains


@dataclass(frozen=True)
class SearchOptions:
    """limit and min_similarity default to the configuration's; rerank None follows it."""

    limit: int | None = None
    rerank: bool | None = None
    path_contains: str | None = None
    after: dt.datetime | None = None
    before: dt.datetime | None = None
    min_similarity: float | None = None

    def __post_init__(self) -> None:
        if self.min_similarity is not None and not 0.0 <= self.min_similarity <= 1.0:
            raise ValueError(f"min_similarity {self.min_similarity} is out of range; must be between 0.0 and 1.0")


@dataclass
class SearchOutcome:
    """Result rows (file_path, chunk_index, score, context, content), the scale of their scores, and warnings."""

    results: DataFrame
    score_kind: str = "vector"
    warnings: list[str] = field(default_factory=list)


def plan_fetch(limit: int, dated: bool, rerank: bool, top_n: int) -> int:
    """How many hits a search that filters dates after the top k fetches."""
    base = max(limit * 10, 100) if dated else limit
    return max(base, top_n) if rerank else base


def resolve_rerank(flag: bool | None, enabled: bool) -> bool:
    return enabled if flag is None else flag


def date_passes(mtime: Column, after: dt.datetime | None, before: dt.datetime | None) -> Column:
    """after <= mtime < before; an unknown mtime passes only without bounds."""
    ok = F.lit(True)
    if after is not None:
        ok = ok & (mtime >= F.lit(after))
    if before is not None:
        ok = ok & (mtime < F.lit(before))
    return F.coalesce(ok, F.lit(False))


def ranked(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc_nulls_last("score"), "file_path", "chunk_index").limit(k)


def vector_search(chunks: DataFrame, query: Sequence[float], k: int, least: float, path: str | None = None) -> DataFrame:
    """The k best chunks (columns of chunks and score) of at least a similarity among paths that contain a part."""
    scored = chunks.where(path_contains(F.col("file_path"), path)).withColumn("score", comparable(cosine_to(F.col("vector"), query)))
    # The best k of those that pass are those that pass of the best k; a filter below the top k would score each row twice.
    return ranked(scored, k).where(passes(F.col("score"), least))


def dated_search(
    chunks: DataFrame, manifest: DataFrame, query: Sequence[float], k: int, least: float, after=None, before=None, path: str | None = None
) -> DataFrame:
    """Search among files whose manifest time lies in the bounds; files that the manifest lacks are left out.

    The manifest (a row per file) joins before the top k. Spark broadcasts it while it is small, by its own size check.
    """
    known = manifest.where(date_passes(F.col("modified_at"), after, before)).select("file_path")
    return vector_search(chunks.join(known, "file_path", "left_semi"), query, k, least, path)


def overfetch_search(chunks: DataFrame, manifest: DataFrame, query: Sequence[float], k: int, least: float, after=None, before=None, path=None) -> DataFrame:
    """The older order: fetch ten times as many, then filter dates. May return fewer than there are."""
    fetched = vector_search(chunks, query, plan_fetch(k, True, False, 0), least, path)
    known = manifest.where(date_passes(F.col("modified_at"), after, before)).select("file_path")
    return ranked(fetched.join(known, "file_path", "left_semi"), k)


def matrix_of(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length in doubles, and which rows are of dim finite components and not zero; others are zero rows."""
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    good = (sizes == dim) & (dim > 0)
    out = np.zeros((len(vectors), dim))
    if not good.any():
        return out, good
    flat = pc.list_flatten(vectors.filter(pa.array(good))).to_numpy(zero_copy_only=False).astype(np.float64)
    out[good] = flat.reshape(-1, dim)
    length = np.sqrt((out * out).sum(axis=1))
    good = good & np.isfinite(length) & (length > 0)
    out[good] /= length[good, None]
    out[~good] = 0.0
    return out, good


def batch_search(chunks: DataFrame, queries: DataFrame, k: int, least: float = -1.0, keys: Sequence[str] = ("file_path", "chunk_index"), part_rows: int = 16384) -> DataFrame:
    """query_id, keys, score and rank of the k best chunks of each query (query_id, query_vector), by matrix products.

    Vectors are dealt to parts of about part_rows; a part's vectors stay in one task and the queries stream by, so memory follows
    neither the number of queries nor that of vectors. A part keeps a query's k best rows, and rows equal to the last of them.
    Scores are rounded to 12 decimals; ties go by the keys.
    """
    parts = max(1, -(-chunks.count() // part_rows))
    place = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("part")
    rows = chunks.select(place, F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), doubles(F.col("vector")).alias("vector"), F.struct(*keys).alias("keys"), F.lit(0).alias("turn"))
    no_keys = F.lit(None).cast(rows.schema["keys"].dataType).alias("keys")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    asked = queries.select(every, "query_id", doubles(F.col("query_vector")).alias("vector"), no_keys, F.lit(1).alias("turn"))
    line = rows.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "turn")
    schema = T.StructType([queries.schema["query_id"], T.StructField("keys", rows.schema["keys"].dataType), T.StructField("score", T.DoubleType())])
    found = line.mapInArrow(_best_of(k, to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(rows.schema["keys"].dataType)), schema)
    found = found.select("query_id", "keys.*", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *keys)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).where(passes(F.col("score"), least))


def _best_of(k: int, id_type: pa.DataType, key_type: pa.DataType, block: int = 512):
    """Of rows (part, query_id, vector, keys, turn) sorted by part and turn: a part's vectors, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, own = None, [], None
        for whole in batches:
            part, turn = whole.column(0).to_numpy(), whole.column(4).to_numpy()
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(turn) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows]):
                if a == b:
                    continue
                if part[a] != here:
                    here, held, own = part[a], [], None
                if turn[a] == 0:
                    held.append(whole.slice(a, b - a).select([2, 3]))
                    continue
                if own is None:
                    own = pa.Table.from_batches(held).combine_chunks() if held else None
                    if own is not None:
                        vectors, keys = own.column(0).combine_chunks(), own.column(1).combine_chunks()
                        dims = int(pc.max(pc.list_value_length(vectors)).as_py() or 0)
                        v, good = matrix_of(vectors, dims)
                for c in range(a, b if own is not None and dims else a, block):
                    batch = whole.slice(c, min(block, b - c))
                    q, known = matrix_of(batch.column(2), dims)
                    scores = np.where(known[:, None] & good, np.round(q @ v.T, 12), -np.inf)
                    last = np.partition(scores, -k, axis=1)[:, -k] if len(good) > k else np.full(len(q), -np.inf)
                    of, at = np.nonzero((scores >= last[:, None]) & np.isfinite(scores))
                    ids = batch.column(1).take(pa.array(of)).cast(id_type)
                    yield pa.RecordBatch.from_arrays([ids, keys.take(pa.array(at)).cast(key_type), pa.array(scores[of, at])], ["query_id", "keys", "score"])

    return run


def result_rows(hits: DataFrame) -> DataFrame:
    """Columns of a result, with the defaults of missing ones."""
    have = set(hits.columns)
    pick = lambda c, d: (F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)).alias(c)
    return hits.select(
        pick("file_path", "unknown"),
        pick("chunk_index", 0).cast("bigint").alias("chunk_index"),
        F.col("score"),
        pick("context", ""),
        pick("content", ""),
    )
