"""Embedders: text to vectors, as columns or in batches on the executors."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



class Embedder(Protocol):
    name: str

    def column(self, df: DataFrame, text: Column, out: str) -> DataFrame:
        """df with a vector column of the text."""

    def one(self, df_session, text: str) -> list[float]:
        """The vector of one query text."""


#: White space that parts tokens, as in functions.text.tokens.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Tokens whose buckets a task remembers.
KNOWN_TOKENS = 500_000


class Buckets(dict):
    """Bucket of a token by its md5, remembered until there are too many."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        found = self[token] = int(hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % self.dim
        return found

    def counts(self, text: str | None) -> np.ndarray:
        text = (text or "").lower()
        # str.split also parts at the separators U+001C to U+001F, which are no blanks here.
        words = filter(None, BLANKS.split(text)) if SEPARATORS.search(text) else text.split()
        return np.bincount(np.fromiter(map(self.__getitem__, words), np.int64), minlength=self.dim).astype(np.float32)


@dataclass(frozen=True)
class HashEmbedder:
    """Token counts by the md5 bucket of the lower-case token: no model and no network."""

    dim: int = 64

    @property
    def name(self) -> str:
        return f"hash-{self.dim}"

    def vector(self, text: Column) -> Column:
        """Bucket counts, a batch at a time: most tokens are frequent, and their buckets are looked up."""
        dim = self.dim

        @F.arrow_udf("array<float>")
        def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            buckets = Buckets(dim)
            for batch in batches:
                flat = [buckets.counts(t.as_py()) for t in batch]
                offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * dim)
                yield pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.float32), *flat])))

        return vectors(text)

    def column(self, df: DataFrame, text: Column, out: str) -> DataFrame:
        return df.withColumn(out, self.vector(text))

    def one(self, spark, text: str) -> list[float]:
        return Buckets(self.dim).counts(text).tolist()


@dataclass(frozen=True)
class HttpEmbedder:
    """A remote model: POST {input, model}, answered by {data: [{embedding, index}]}; batches run in parallel by partition.

    Answers are put in order by index, and one that is shorter than the batch is an error. A batch whose connection fails, or that
    is answered 429 or 5xx, is sent again up to max_retries times, after pauses that double.
    """

    endpoint: str
    model: str
    api_key: str | None = None
    batch_size: int = 32
    timeout: float = 30
    max_retries: int = 0
    pause: float = 0.5

    @property
    def name(self) -> str:
        return self.model

    def send(self, texts: list[str]) -> list[dict]:
        """The answer's rows, in the order they come."""
        body = json.dumps({"input": texts, "model": self.model}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(self.endpoint, body, headers)
        for turn in range(self.max_retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return json.load(reply)["data"]
            except urllib.error.HTTPError as e:
                if turn == self.max_retries or (e.code != 429 and e.code < 500):
                    raise RuntimeError(f"embedding failed with status {e.code}: {e.read().decode(errors='replace')}") from None
            except urllib.error.URLError:
                if turn == self.max_retries:
                    raise
            time.sleep(self.pause * 2**turn)
        return []

    def embed(self, texts: list[str]) -> list[list[float]]:
        vectors = [d["embedding"] for d in sorted(self.send(texts), key=lambda d: d.get("index", 0))]
        if len(vectors) != len(texts):
            raise RuntimeError(f"{len(vectors)} embeddings for {len(texts)} texts")
        return vectors

    def column(self, df: DataFrame, text: Column, out: str) -> DataFrame:
        embed, size = self.embed, self.batch_size

        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                found: list = []
                for k in range(0, len(batch), size):
                    found += embed(batch.iloc[k : k + size].tolist())
                yield pd.Series(found)

        return df.withColumn(out, vectors(text))

    def one(self, spark, text: str) -> list[float]:
        return self.embed([text])[0]


@dataclass(frozen=True)
class PrecomputedEmbedder:
    """Vectors of a table (text, vector), joined by text."""

    vectors: DataFrame
    name: str = "precomputed"

    def column(self, df: DataFrame, text: Column, out: str) -> DataFrame:
        known = self.vectors.select(F.col("text").alias("_text"), F.col("vector").alias(out))
        return df.withColumn("_key", text).join(known, F.col("_key") == F.col("_text")).drop("_key", "_text")

    def one(self, spark, text: str) -> list[float]:
        row = self.vectors.where(F.col("text") == text).select("vector").head()
        if row is None:
            raise KeyError(text)
        return list(row["vector"])
