"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint emits every variant within half the radius, variants are shuffled, and fingerprints meet at shared variants.
With radius 3 the half is 1 (rounded down), in two rounds:

1. Each distinct fingerprint emits the 65 variants within one bit. Two fingerprints at distance 2 or less share a variant,
   and all that share one are within distance 2 of each other, so a star to the least of them links them without
   comparing pairs. A variant has at most 65 fingerprints, whatever the data.
2. A pair at distance 3 has one of three blocks of bits (21 or 22) with a differing bit, and at most two in the rest. Each
   fingerprint emits, for each block left out, the variants within one bit of its other 42 or 43 bits: 131 in all. Variants
   that only fingerprints of one component of round 1 share are dropped; at the others, pairs of different components are
   verified by bit count. Random fingerprints rarely meet on so many bits: 3 candidates each among 10**10.

Emitting the full ball of radius 2 on one side instead takes 2,081 variants a fingerprint; see README for figures.

Exact copies share a fingerprint and are one node. Components come from alternating star contraction over shuffled edges,
with each round written to the shared folder; nothing is collected but counts.

Defined cases: null, empty and blank texts have no words, fingerprint zero and are linked like any other; null doc_id is
ignored when the least of a component is taken (null if it has no other); repeated rows are kept, but representatives() keeps
one of them; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semdex.llm.common import materialize, release, sliced, small_batches

SEED = 42
LANES = np.uint64(0x0101010101010101)
#: Rows of one key that a task holds at a time.
HELD = 1_000_000


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of every word shingle; one of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bits set in over half the shingle hashes; bits are counted in byte lanes, 255 hashes at a time."""
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    chunks = np.arange(0, len(h), 255)
    out = 0
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & LANES, chunks)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > len(h)).tolist():
            out |= 1 << (8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, width: int = 3, with_digest: bool = False) -> DataFrame:
    """doc_id and its 64-bit fingerprint as a signed long; with_digest also the text's MD5."""
    more = ["digest"] * with_digest

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches):
            fps = np.array([fingerprint(t, width) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps} | {c: pdf[c] for c in more})

    kind = docs.schema["doc_id"].dataType
    columns = [F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")]
    cast = small_batches(docs).select(*columns, *[digest_of("text").alias(c) for c in more])
    schema = "doc_id string, fp long" + ", digest string" * with_digest
    return cast.mapInPandas(score, schema).select(F.col("doc_id").cast(kind), "fp", *more)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node reachable.

    Alternating large-star and small-star contraction; both replace edges by edges to the least neighbour, so the edge
    count does not grow, and stop when a round changes nothing. Edges that still change in the last round are an error.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        joined = large.join(low, large["a"] == low["u"])
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, edges = edges, materialize(small.where("a <> b").distinct(), "edges")
        release(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
    out.written_to = edges.written_to
    return out


def bit(k: int) -> int:
    """1 << k as a signed 64-bit number."""
    return (1 << k) if k < 63 else -(1 << 63)


#: Bits of the blocks of round 2, one of which is left out at a time.
BLOCKS = (range(0, 21), range(21, 42), range(42, 64))


def balls(nodes: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """Columns of nodes and, for each (kept, flipped) mask, the key fp & kept ^ flipped. The masks are one folded literal: an
    array of as many expressions is too long a method for the JIT compiler."""
    line = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("kept"), F.lit(m).cast("long").alias("flipped")) for k, m in masks]))
    return nodes.withColumn("mask", line).withColumn("key", F.col("fp").bitwiseAND(F.col("mask.kept")).bitwiseXOR(F.col("mask.flipped"))).drop("mask")


WHOLE_BALL = [(-1, m) for m in (0, *(bit(k) for k in range(64)))]
#: For each block left out (its bits zero), the variants of the other bits within one bit.
PARTIAL_BALLS = [
    (sum(bit(k) for k in range(64) if k not in block), m) for block in BLOCKS for m in (0, *(bit(k) for k in range(64) if k not in block))
]


def mixed_of(most: int = HELD):
    """Of rows (key, fp, root) sorted by key, those of keys with more than one root. A key that spans batches waits for its last
    row; more than ``most`` waiting rows go out as they are, since what meets at a key is verified anyway."""

    def rows(columns: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], names=["key", "fp", "root"])

    def several(key: np.ndarray, root: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        return np.repeat(mixed, np.diff(np.append(starts, len(key))))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        over: int | None = None  # the key whose rows go out as they are
        for batch in batches:
            columns = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            key = columns[0]
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            keep = several(key, columns[2]) if over is None else several(key, columns[2]) | (key == over)
            if len(key) - cut > most or key[-1] == over:
                over = int(key[-1])
                yield rows(columns, keep | (key == over))
                held = [x[:0] for x in columns]
                continue
            if cut:
                yield rows([x[:cut] for x in columns], keep[:cut])
            held = [x[cut:] for x in columns]
        if len(held[0]):
            yield rows(held, several(held[0], held[2]))

    return emit


def near_components(fps: DataFrame) -> DataFrame:
    """(fp, root) of every distinct fingerprint: root is common to those linked by steps of 3 or fewer differing bits."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out anew before each explode, since few bytes of fingerprints would else be one task's.
    nodes = fps.select("fp").distinct()
    star = balls(nodes.repartition(n), WHOLE_BALL).withColumn("m", F.min("fp").over(Window.partitionBy("key")))
    first = components(star.where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")))
    rooted = materialize(
        nodes.join(first, nodes["fp"] == first["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    release(first)
    near = balls(rooted.repartition(n), PARTIAL_BALLS).select("key", "fp", "root").repartition(n, "key").sortWithinPartitions("key")
    mixed = materialize(near.mapInArrow(mixed_of(), "key long, fp long, root long"), "mixed")
    other = mixed.select(F.col("key").alias("key2"), F.col("fp").alias("f1"), F.col("root").alias("r1"))
    met = mixed.join(other, (F.col("key") == F.col("key2")) & (F.col("root") > F.col("r1")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("f1"))) <= 3))
    second = components(met.select(F.col("root").alias("a"), F.col("r1").alias("b")))
    release(mixed)
    return rooted.join(second, rooted["root"] == second["node"], "left").select("fp", F.coalesce(second["root"], rooted["root"]).alias("root"))


def named_components(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, least, root) of every distinct fingerprint and (root, component_id) of every component."""
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    by_fp = least.join(near_components(fps), "fp")
    return by_fp, by_fp.groupBy("root").agg(F.min("least").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links of 3 or fewer differing bits)."""
    fps = materialize(fingerprints(docs, width), "fingerprints")
    by_fp, roots = named_components(fps)
    named = by_fp.join(roots, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def row_key(doc_id: str, digest: Column) -> Column:
    """One text column that tells rows of different ids or texts apart; null ids are apart from empty ones."""
    return F.concat(F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.lit("n")), F.lit(":"), digest)


def digest_of(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def representatives(docs: DataFrame, width: int = 3) -> DataFrame:
    """One document of each component: that of its least doc_id (null after all others) and then of the least MD5 of the text.

    Rows that agree in doc_id and text are one document. The rows keep the columns of docs.
    """
    fps = materialize(fingerprints(docs, width, with_digest=True), "fingerprints")
    # Least of each fingerprint first, so that copies do not gather by root.
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    by_fp = fps.groupBy("fp").agg(F.min(order).alias("least"))
    least = by_fp.join(near_components(fps), "fp").groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.digest")
    chosen = least.select(row_key("doc_id", F.col("digest")).alias("rep"))
    # One key column for the join and for rows that repeat a document, so that texts are shuffled once.
    rows = docs.select(F.struct(*docs.columns).alias("d"), row_key("doc_id", digest_of("text")).alias("own"))
    kept = rows.join(chosen, F.col("own") == F.col("rep"), "left_semi").groupBy("own").agg(F.first("d").alias("d"))
    return kept.select(*[F.col("d")[c].alias(c) for c in docs.columns])


def op6(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
