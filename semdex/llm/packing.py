"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two of n's binary form, the largest (max_len)
repeated first. Each piece is a sequence of its own in the bucket of its length: no sequence crosses documents and none
needs padding. One pass over the documents, no shuffle: a sequence's id is its partition and its rank there.

Tokens are those of a byte-level BPE file of the `tokenizers` library. Texts of ASCII and Latin letters, which its special
token's string does not occur in, go through the same vocabulary's rank file, some four times as fast; others through the
library itself (its expression engine may class rare characters otherwise). Tests hold both to equal ids.

Defined cases: null and empty texts are documents of the end token only; repeated rows are packed each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdex.llm.common import sliced, small_batches

MAX_LEN = 2048
END = 1
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ɏ]*")


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """max_len as often as it fits, then the remaining powers of two of n, largest first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


@functools.cache
def encoders(json_path: str, ranks_path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    fast = None
    if ranks_path:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_ids(text: str | None, json_path: str, ranks_path: str | None = None) -> list[int]:
    slow, fast = encoders(json_path, ranks_path)
    text = text or ""
    if fast is not None and "<|" not in text and PLAIN.fullmatch(text):
        return fast.encode_ordinary(text)
    return slow.encode(text, add_special_tokens=False).ids


def packed(docs: DataFrame, json_path: str, ranks_path: str | None = None, max_len: int = MAX_LEN, end_id: int = END, with_ids: bool = True) -> DataFrame:
    """A row for each piece: its document, place, length, sequence and, with_ids, its token ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        following = (task.partitionId() if task else 0) << 40
        for batch in sliced(batches):
            docs_, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.array(token_ids(text.as_py(), json_path, ranks_path) + [end_id], "<u4")
                at, raw = 0, tokens.tobytes()
                for n in piece_lengths(len(tokens), max_len):
                    docs_.append(doc_id)
                    starts.append(at)
                    lengths.append(n)
                    crcs.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    totals.append(len(tokens))
                    if with_ids:
                        ids.append(tokens[at : at + n].astype(np.int32))
                    at += n
            sequences = range(following, following + len(docs_))
            following += len(docs_)
            columns = [pa.array(docs_, pa.string()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals, sequences))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long" + ", ids array<int>" * with_ids
    out = small_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, schema)
    bucket = F.log2("length").cast("int")
    return out.withColumns({"doc_id": F.col("doc_id").cast(kind), "offset": F.lit(0).cast("long"), "bucket": bucket})


def op8(docs: DataFrame) -> DataFrame:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
    return packed(docs, *default_paths(), with_ids=False).select(names)
