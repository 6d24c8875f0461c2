"""Incremental indexing: crawl, diff against the manifest, chunk and embed what changed, commit one snapshot."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex import SCHEMA_VERSION
from semdex.config import Config, load_for_index
from semdex.functions.embedding import Embedder, HttpEmbedder
from semdex.functions.text import chunk_id, embedded_text, trim_unicode
from semdex.operators import chunking, diff, stats
from semdex.plans.store import Meta, Store
from semdex.sources import code, crawl

LOG = logging.getLogger("semdex")


@dataclass(frozen=True)
class IndexStats:
    index_path: str
    root_path: str
    file_count: int
    chunk_count: int
    estimated_tokens: int
    last_indexed: dt.datetime | None
    size_on_disk: int
    model: str
    endpoint: str


def http_embedder(config: Config) -> HttpEmbedder:
    e = config.embedding
    return HttpEmbedder(e.endpoint, e.model, e.api_key, e.batch_size, e.timeout_seconds, e.max_retries)


def all_chunks(texts: DataFrame, config: Config) -> DataFrame:
    """Chunks of files (file_path, text) in one pass: syntax chunks where a file has them, split text for the others."""
    readable = texts.where(trim_unicode(F.col("text")) != "")
    plain = chunking.pieces(F.col("file_path"), F.col("text"), config.chunking)
    found = plain
    if config.chunking.use_syntax:
        found = F.coalesce(code.syntax_pieces(F.col("file_path"), F.col("text"), config.chunking), plain)
    return chunking.numbered(readable.select("file_path", found.alias("pieces")))


class Indexer:
    def __init__(self, spark: SparkSession, root: str | Path, config: Config | None = None, embedder: Embedder | None = None):
        self.spark, self.root = spark, Path(root).absolute()
        self.config = config or load_for_index(self.root)
        self.embedder = embedder or http_embedder(self.config)
        self.store = Store(spark, self.root)

    def refresh(self, quiet: bool = False) -> int:
        """Bring the index up to date with the file tree; how many files got chunks.

        quiet prints nothing and refuses to drop an index of another schema version. Any failure leaves the last snapshot.
        Files that cannot be read are not in the manifest, so the next run tries them again.
        """
        files = crawl.crawl(self.spark, self.root, self.config.indexing)
        return self.refresh_from(files, lambda changed: crawl.read_texts(changed, self.config.chunking.max_file_size_mb), quiet)

    def refresh_from(self, files: DataFrame, read: Callable[[DataFrame], DataFrame], quiet: bool = False) -> int:
        """The same for any table of files (file_path, modified_ns, ...): read gives the changed ones a text or a problem."""
        meta = self.store.meta()
        if quiet and meta is not None and meta.schema_version != SCHEMA_VERSION:
            raise RuntimeError(f"index schema is outdated (v{meta.schema_version} vs current v{SCHEMA_VERSION}); index {self.root} again to migrate")
        if self.store.migrate() and not quiet:
            print(f"Index schema is outdated; rebuilding from scratch (schema v{SCHEMA_VERSION}).")
        cached: list[DataFrame] = []

        def kept(df: DataFrame) -> DataFrame:
            cached.append(df.cache())
            return df

        try:
            files = kept(files)
            state = kept(diff.classify(files, self.store.manifest()))
            counts = {r["status"]: r["count"] for r in state.groupBy("status").count().collect()}
            LOG.info("%s: files %s", self.root, counts)
            if self.store.meta() is not None and not set(counts) - {"unchanged"}:
                return 0
            changed = files.join(state.where(F.col("status").isin("new", "modified")), "file_path", "left_semi")
            gone = state.where(F.col("status").isin("modified", "deleted"))
            texts = kept(read(changed))
            cut = all_chunks(texts.where(F.col("problem").isNull()), self.config)
            vectors = self.embedder.column(cut, embedded_text(F.col("context"), F.col("content")), "vector")
            times = texts.select("file_path", "modified_ns")
            mtime = F.timestamp_micros(F.expr("modified_ns div 1000"))
            fresh = kept(vectors.join(times, "file_path").select(
                chunk_id(F.col("file_path"), F.col("chunk_index"), F.col("content")).alias("id"),
                F.col("vector").cast("array<float>").alias("vector"),
                "file_path",
                F.col("chunk_index").cast("bigint").alias("chunk_index"),
                "content",
                "context",
                F.col("token_count").cast("bigint").alias("token_count"),
                mtime.alias("mtime"),
            ))
            low, high, refreshed = fresh.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.countDistinct("file_path")).head()
            if low is not None:
                if low != high:
                    raise RuntimeError(f"the embedder gave vectors of {low} to {high} dimensions")
                self.store.check(low, self.embedder.name)
            ids = fresh.groupBy("file_path").agg(F.collect_list("id").alias("chunk_ids"))
            entries = texts.where(F.col("problem").isNull()).join(ids, "file_path", "left").select(
                "file_path", "modified_ns", mtime.alias("modified_at"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids")
            )
            dim = low if low is not None else meta.dim if meta else None
            self.store.commit(fresh, entries, gone, Meta(SCHEMA_VERSION, dim, self.embedder.name))
            LOG.info("%s: %d files got chunks", self.root, refreshed)
            return refreshed
        finally:
            for df in cached:
                df.unpersist()

    def rebuild(self) -> int:
        self.store.wipe()
        return self.refresh()

    def stats(self) -> IndexStats:
        row = stats.stats(self.store.chunks(), self.store.manifest()).head()
        e = self.config.embedding
        return IndexStats(
            str(self.store.dir), str(self.root), row["file_count"], row["chunk_count"], row["estimated_tokens"], row["last_indexed"], self.store.size_on_disk(), e.model, e.endpoint
        )
