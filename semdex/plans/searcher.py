"""Search over a stored index: text to vector, filters, top k, rerank."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex.config import Config, load_for_index
from semdex.functions.embedding import Embedder
from semdex.operators import rerank, search, similar
from semdex.operators.search import SearchOptions, SearchOutcome
from semdex.plans.indexer import Indexer, http_embedder
from semdex.plans.store import Store
from semdex.sources import crawl

SIMILAR_BYTES = 8000


def head_bytes(text: str, limit: int = SIMILAR_BYTES) -> str:
    """The longest prefix of at most limit bytes that splits no character."""
    return text.encode()[:limit].decode("utf-8", "ignore")


class Searcher:
    def __init__(self, spark: SparkSession, root: str | Path | None = None, config: Config | None = None, embedder: Embedder | None = None, scorer: rerank.Scorer | None = None):
        found = Path(root) if root is not None else crawl.find_index_root(Path.cwd())
        if found is None:
            raise FileNotFoundError("No index found in directory tree")
        self.spark, self.root = spark, found.absolute()
        self.config = config or load_for_index(self.root)
        self.embedder = embedder or http_embedder(self.config)
        r = self.config.reranker
        self.scorer = scorer or rerank.HttpReranker(r.endpoint, r.model, r.api_key)
        self.store = Store(spark, self.root)

    def auto_index(self) -> tuple[int, list[str]]:
        """A quiet refresh; a failure becomes a warning and the index as it is gets searched."""
        try:
            return Indexer(self.spark, self.root, self.config, self.embedder).refresh(quiet=True), []
        except Exception as e:
            return 0, [f"auto-index failed ({e}); searching the existing index"]

    def search(self, text: str, options: SearchOptions | None = None) -> SearchOutcome:
        """Vector search with the filters, then the rerank. The threshold holds for vector scores only."""
        options = options or SearchOptions()
        limit = self.config.query.default_limit if options.limit is None else options.limit
        least = self.config.query.min_similarity if options.min_similarity is None else options.min_similarity
        reranks = search.resolve_rerank(options.rerank, self.config.reranker.enabled)
        query = self.embedder.one(self.spark, text)
        self.store.check(len(query), self.embedder.name)
        chunks = self.store.chunks()
        if options.after is not None or options.before is not None:
            # A chunk carries its file's time, so the bounds reach the scan.
            chunks = chunks.where(search.date_passes(F.col("mtime"), options.after, options.before))
        fetch = search.plan_fetch(limit, False, reranks, self.config.reranker.top_n)
        found = search.vector_search(chunks, query, fetch, least, options.path_contains)
        rows, kind, warnings = rerank.apply_rerank(search.result_rows(found), text, limit, self.scorer if reranks else None, self.config.reranker.top_n)
        return SearchOutcome(rows, kind, warnings)

    def similar(self, file: str | Path, limit: int = 10, fetch: int = 20) -> DataFrame:
        """Files like a file, by its first 8,000 bytes of text (extracted first, where its format needs that)."""
        text, problem = crawl.text_of(str(file), Path(file).read_bytes())
        if problem:
            raise ValueError(f"Failed to read file: {problem}")
        if not text.strip():
            raise ValueError("File is empty")
        query = self.embedder.one(self.spark, head_bytes(text))
        return similar.similar_files(self.store.chunks(), query, str(file), fetch, limit)
