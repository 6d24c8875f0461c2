"""Reranking of candidates by a second model, with the vector order as fallback."""

from __future__ import annotations

import json
import math
import urllib.request
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from semdex.functions.text import tokens
from semdex.operators.search import ranked


class Scorer(Protocol):
    def rerank(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        """(place of the document, relevance), in any order; places out of range are dropped."""


@dataclass(frozen=True)
class HttpReranker:
    """POST {model, query, documents}, answered by {results: [{index, relevance_score}]}."""

    endpoint: str
    model: str
    api_key: str | None = None
    timeout: float = 60

    def rerank(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        if not documents:
            return []
        body = json.dumps({"model": self.model, "query": query, "documents": documents}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        with urllib.request.urlopen(urllib.request.Request(self.endpoint, body, headers), timeout=self.timeout) as reply:
            return [(int(r["index"]), float(r["relevance_score"])) for r in json.load(reply)["results"]]


def overlap(query: Column, content: Column) -> Column:
    """Share of the query's distinct lower-case tokens that the content has; 0 for a query without tokens."""
    q = F.array_distinct(tokens(F.lower(query)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(F.lower(content)))).cast("double"), F.size(q)), F.lit(0.0))


@dataclass(frozen=True)
class LexicalReranker:
    """Token overlap: a scorer that needs no model."""

    def rerank(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        q = set(query.lower().split())
        return [(k, len(q & set(d.lower().split())) / len(q) if q else 0.0) for k, d in enumerate(documents)]


def rerank_lexical(hits: DataFrame, query: Column, limit: int, top_n: int = 50) -> DataFrame:
    """The lexical rerank as one plan: cap the candidates, score, and take the best, ties in vector order."""
    capped = ranked(hits, max(top_n, limit))
    scored = capped.withColumn("relevance", overlap(query, F.col("content")))
    return scored.orderBy(F.desc("relevance"), F.desc("score"), "file_path", "chunk_index").limit(limit)


def apply_rerank(hits: DataFrame, query: str, limit: int, scorer: Scorer | None, top_n: int = 50) -> tuple[DataFrame, str, list[str]]:
    """(results, score kind, warnings). Without a scorer, or a hit, the vector order; if the scorer fails, that and a warning.

    At most max(top_n, limit) rows come to the driver. The similarity threshold is not applied to rerank scores.
    """
    spark = hits.sparkSession
    if scorer is None:
        return ranked(hits, limit), "vector", []
    rows = ranked(hits, max(top_n, limit)).collect()
    if not rows:
        return spark.createDataFrame([], hits.schema), "vector", []
    try:
        found = scorer.rerank(query, [r["content"] or "" for r in rows])
    except Exception as e:  # the fallback is the contract: whatever goes wrong, vector scores stand
        return spark.createDataFrame(rows[:limit], hits.schema), "vector", [f"Reranking failed, using vector scores: {e}"]
    valid = [(k, s) for k, s in found if 0 <= k < len(rows)]
    valid.sort(key=lambda x: (math.isnan(x[1]), -x[1] if not math.isnan(x[1]) else 0.0))
    out = [Row(**(rows[k].asDict() | {"score": s})) for k, s in valid[:limit]]
    return spark.createDataFrame([tuple(r[c] for c in hits.columns) for r in out], hits.schema), "reranker", []
