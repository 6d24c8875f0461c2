"""Chunking texts into token-bounded pieces, with higher-order functions; a vocabulary's tokens are counted in Python.

A text is split into segments by its kind; segments are packed greedily in order, joined by a blank line, and a segment above
the bound is cut into overlapping windows. A token is a white-space token (see functions.text), or one of a vocabulary; blank texts have no chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdex.config import Chunking
from semdex.functions.binding import let
from semdex.functions.text import tokens, trim_unicode
from semdex.functions.tokenizer import Vocabulary, WhiteSpace, tokenizer
from semdex.operators.routing import file_type


Trim = Callable[[Column], Column]


def _cleaned(parts: Column, trim: Trim) -> Column:
    return F.filter(F.transform(parts, trim), lambda s: s != "")


def split_prose(text: Column, trim: Trim = trim_unicode) -> Column:
    """Blocks between blank lines, trimmed; none if all are blank."""
    return _cleaned(F.split(text, r"\n\n|\r\n\r\n"), trim)


def split_code(text: Column, trim: Trim = trim_unicode) -> Column:
    """As prose, but the whole text if there is no block; null of a null text."""
    return let(split_prose(text, trim), lambda parts: F.when(F.size(parts) == 0, F.array(text)).otherwise(parts))


def split_markdown(text: Column, trim: Trim = trim_unicode) -> Column:
    """Blocks between blank lines and before every line that starts with #."""
    return _cleaned(F.split(text, r"\n(?=#)|\n\n"), trim)


def split_segments(kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "code", split_code(text))
        .when(kind == "markdown", split_markdown(text))
        .when(kind == "prose", split_prose(text))
        .otherwise(F.array(text))
    )


def windows(toks: Column, max_tokens: int, overlap: int) -> Column:
    """Windows of max_tokens tokens, each overlap short of the end of the one before, the last ending with the text."""
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be at least 0 and less than max_tokens")
    step = max_tokens - overlap

    def cut(t: Column) -> Column:
        n = F.size(t)
        count = F.when(n <= max_tokens, F.lit(1)).otherwise(F.ceil((n - max_tokens) / F.lit(step)).cast("int") + 1)
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(t, k * step + 1, max_tokens))

    return let(toks, cut)


PIECE = "struct<content: string, n: int>"


def packed(segments: Column, max_tokens: int, overlap: int) -> Column:
    """Array of (content, n) in order. A join counts two tokens, which the bound does not see, so n may pass it by two."""

    def piece(content: Column, n: Column) -> Column:
        return F.struct(content.alias("content"), n.cast("int").alias("n"))

    empty = F.array().cast(f"array<{PIECE}>")

    def flushed(acc: Column) -> Column:
        return F.when(acc["n"] > 0, F.concat(acc["done"], F.array(piece(acc["text"], acc["n"])))).otherwise(acc["done"])

    def step(acc: Column, seg: Column) -> Column:
        state = lambda done, text, n: F.struct(done.alias("done"), text.alias("text"), n.cast("int").alias("n"))
        cut = F.transform(windows(seg["toks"], max_tokens, overlap), lambda w: piece(F.array_join(w, " "), F.size(w)))
        n = F.size(seg["toks"])
        return (
            F.when(n > max_tokens, state(F.concat(flushed(acc), cut), F.lit(""), F.lit(0)))
            .when((acc["n"] > 0) & (acc["n"] + n > max_tokens), state(flushed(acc), seg["text"], n))
            .when(acc["n"] > 0, state(acc["done"], F.concat(acc["text"], F.lit("\n\n"), seg["text"]), acc["n"] + n + 2))
            .otherwise(state(acc["done"], seg["text"], n))
        )

    start = F.struct(empty.alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"))
    measured = F.transform(segments, lambda s: F.struct(s.alias("text"), tokens(s).alias("toks")))
    return F.aggregate(measured, start, step, flushed)


def packed_list(segments: Iterable[str | None], counter: WhiteSpace | Vocabulary, max_tokens: int, overlap: int) -> list[dict]:
    """packed() of one list, by any counter of tokens."""
    out: list[dict] = []
    held, size = [], 0

    def flush() -> None:
        if held:
            out.append({"content": "\n\n".join(held), "n": size})
            held.clear()

    for seg in segments:
        n = 0 if seg is None else counter.count(seg)
        if n > max_tokens:
            flush()
            out.extend({"content": c, "n": k} for c, k in counter.windows(seg, max_tokens, overlap))
        elif n:
            if held and size + n > max_tokens:
                flush()
            size = size + n + 2 if held else n
            held.append(seg)
    flush()
    return out


def packed_by_vocabulary(segments: Column, config: Chunking) -> Column:
    """packed() with the tokens of the configured vocabulary, in Arrow batches."""
    path, max_tokens, overlap = config.tokenizer, config.max_chunk_tokens, config.overlap_tokens

    @F.pandas_udf(f"array<{PIECE}>")
    def found(lists: pd.Series) -> pd.Series:
        counter = tokenizer(path)
        return pd.Series([None if x is None else packed_list(x, counter, max_tokens, overlap) for x in lists], dtype=object)

    return found(segments)


def pieces(path: Column, text: Column, config: Chunking) -> Column:
    """Array of (content, n, context) of a file's split text; null where the text is blank."""
    segments = split_segments(file_type(path), F.when(trim_unicode(text) != "", text))
    found = packed_by_vocabulary(segments, config) if config.tokenizer else packed(segments, config.max_chunk_tokens, config.overlap_tokens)
    return F.transform(found, lambda p: F.struct(p["content"].alias("content"), p["n"].alias("n"), F.lit("").alias("context")))


def numbered(files: DataFrame) -> DataFrame:
    """file_path, chunk_index, content, context, token_count of files (file_path, pieces).

    The outer form, since for the inner one the optimizer adds a filter on the size of the pieces, which makes them twice.
    """
    return files.select("file_path", F.posexplode_outer("pieces").alias("chunk_index", "piece")).where("piece IS NOT NULL").select(
        "file_path",
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("piece.content").alias("content"),
        F.col("piece.context").alias("context"),
        F.col("piece.n").cast("bigint").alias("token_count"),
    )


def chunked(files: DataFrame, config: Chunking | None = None) -> DataFrame:
    """file_path, chunk_index, content, token_count of files (file_path, text); files without text have no rows."""
    own = files.select("file_path", pieces(F.col("file_path"), F.col("text"), config or Chunking()).alias("pieces"))
    return numbered(own).drop("context")
