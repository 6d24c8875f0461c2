"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

A trie of the vocabulary carries, at each node, a failure link and the number of pieces popped on following it, so the
greedy longest-match-first piece count of a word takes one pass over its bytes and no piece is built. Words are looked up
in a bounded cache, since most are frequent.

Words are maximal runs of characters other than ASCII white space. Initial pieces start a word, continuing pieces follow;
a word that no sequence of greedy matches covers counts as one unknown piece.

Defined cases: null, empty and blank texts count zero; a word of any length takes linear time; repeated rows are counted
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdex.llm.common import small_batches

CACHE_WORDS = 1_000_000


class LongestMatch:
    """goto[node * 256 + byte]; fail[node] (-1: none) and popped[node] as precomputed for every node."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        self.goto: dict[int, int] = {}
        token = [False, False]
        self.start, self.middle = 0, 1
        depth_first: list[tuple[int, int, int]] = []
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for b in piece:
                    key = node << 8 | b
                    if (following := self.goto.get(key)) is None:
                        following = self.goto[key] = len(token)
                        token.append(False)
                        depth_first.append((node, b, following))
                    node = following
                if piece:
                    token[node] = True
        children: dict[int, list[tuple[int, int]]] = {}
        for node, b, following in depth_first:
            children.setdefault(node, []).append((b, following))
        self.fail, self.popped = [-1] * len(token), [0] * len(token)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for b, child in children.get(node, ()):
                if token[child]:
                    self.fail[child], self.popped[child] = self.middle, 1
                else:
                    z, n = self.fail[node], self.popped[node]
                    while z >= 0 and (z << 8 | b) not in self.goto:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[child], self.popped[child] = self.goto[z << 8 | b], n
                queue.append(child)

    def count(self, word: bytes) -> int:
        """Pieces of a word; -1 if it is unknown."""
        goto, fail, popped = self.goto, self.fail, self.popped
        node, n = self.start, 0
        for b in word:
            while (following := goto.get(node << 8 | b)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = following
        while node != self.middle:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return n


class Counts(dict):
    """Piece counts by word, emptied when full."""

    def __init__(self, automaton: LongestMatch, limit: int = CACHE_WORDS):
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n


@functools.cache
def from_ranks(path: str) -> LongestMatch:
    """Vocabulary of a byte-level rank file: tokens after a space start words (the space dropped), others continue them.

    The single bytes are initial pieces as well, so that no word is unknown.
    """
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f]
    single = [bytes([b]) for b in range(256)]
    initial = dict.fromkeys([t[1:] for t in tokens if t[:1] == b" " and len(t) > 1 and b" " not in t[1:]] + single)
    return LongestMatch(initial, [t for t in tokens if b" " not in t])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counts(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens (an unknown word is one) and n_unknown of every whole text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(from_ranks(ranks_path))
        for pdf in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for text in pdf["text"]:
                found = list(map(counts.__getitem__, (text or "").encode("utf-8", "surrogatepass").split()))
                bad = found.count(-1)
                n_words.append(len(found))
                n_tokens.append(sum(found) + 2 * bad)
                n_unknown.append(bad)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": n_words, "n_tokens": n_tokens, "n_unknown": n_unknown})

    kind = docs.schema["doc_id"].dataType
    cast = small_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = cast.mapInPandas(count, "doc_id string, n_words long, n_tokens long, n_unknown long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op7(docs: DataFrame) -> DataFrame:
    return token_counts(docs, default_path())
