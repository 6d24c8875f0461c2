"""Removal of repeated 100-byte strings by external suffix sorting over shards.

Texts are UTF-8 bytes; a byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or
the same document further ahead), judged on the input.

1. Every window of ``length`` bytes has an anchor: the ``GRAM``-byte string in it of least hash, leftmost of equals. Windows
   with equal bytes have equal anchors, so a window can only repeat among windows of equal anchors, and windows of
   neighbouring starts mostly share their anchor. A run of windows with one anchor, and the bytes they cover, is a context.
2. Contexts are shuffled by anchor. One whose anchor occurs nowhere else repeats nothing. One equal to an earlier context, in
   full, repeats in full. Otherwise, different contexts share an anchor: these are ambiguous, and one of each is kept.
3. An ambiguous context's windows fall into two classes, with the anchor in their first or second half. Equal windows are of
   one class and share its core, 66 bytes to the right or left of the anchor's begin or end. The texts of each class form
   shards by core, so a short line that very many documents hold spreads over shards. Induced suffix sorting of a shard
   (disk-backed queues of suffix tuples with common-prefix values, see induced_sort) finds each window's earliest equal.
4. A core of more than two shards, a passage that very many documents hold in different surroundings, does not go to one task:
   its windows are settled within groups of texts and dealt by the hash of all their bytes.

Only ambiguous contexts are suffix-sorted; README has the figures that make sorting all suffixes impossible within the limits.
Copies found within about GROUP bytes of a task's rows are settled there and leave one row for the shuffle, so a passage that a third of all
documents hold does not gather in one task; documents and their intervals meet by a shuffle on doc_id and text hash.

Defined cases: null text is empty; a null doc_id counts as larger than any other; rows equal in doc_id and text are one
document and get the same result; rows of equal doc_id and different texts are ordered by a hash of the text; a text of any length
is read in segments; doc_id of another type than an integer is refused; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from semdex.llm.common import materialize, sliced, small_batches
from semdex.llm.induced_sort import Scratch, repeated

LENGTH = 100
GRAM = 32
SEGMENT = 1 << 20
GROUP = 4 << 20
SHARD = 4 << 20
#: Tuples that a queue of the sort holds in memory, and the most substrings or names it sorts at once.
QUEUE = 1 << 18
IN_MEMORY = 1 << 21
#: Texts of a core that are recognised when they come again, and rows that are read back at once.
KNOWN = 20_000
ROWS = 1 << 16
BROADCAST = 10_000
LAST = (1 << 63) - 1

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out)


class Rolling:
    """Polynomial hashes modulo 2**64 of all substrings, from prefix sums; byte values are random 64-bit words."""

    table = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
    down, up = _powers(INVERSE, 1), _powers(BASE, 1)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling.up) < n + 1:
            Rolling.down, Rolling.up = _powers(INVERSE, n + 1), _powers(BASE, n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(self.table[data] * self.down[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.up[begin])

    def grams(self, k: int) -> np.ndarray:
        return mixed((self.sums[k:] - self.sums[:-k]) * self.up[: len(self.sums) - k])


def mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def contexts(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: text index, first start, last start, the anchor's distance from the first
    start, anchor hash, context hash."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < length:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, U),) * 2
    rolling = Rolling(data)
    h = rolling.grams(gram)
    key = (h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    count = n - length + 1
    least = np.minimum(key[:count], key[width - span : width - span + count])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    long_ = sizes >= length
    edge = np.zeros(n + 1, np.int32)
    edge[starts[long_]] += 1
    np.subtract.at(edge, ends[long_] - length + 1, 1)
    p = np.flatnonzero(np.cumsum(edge)[:count] > 0)
    if not len(p):
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, U),) * 2
    anchor = (least[p] & U(0xFFFFFFFF)).astype(np.int64)
    turn = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(p) != 1)]))
    lo, hi, at = p[turn], p[np.append(turn[1:] - 1, len(p) - 1)], anchor[turn]
    doc = np.searchsorted(ends, lo, "right")
    context = mixed(rolling.of(lo, hi + length) + (at - lo).astype(U) * U(0xA24BAED4963EE407))
    return doc, lo - starts[doc], hi - starts[doc], at - lo, h[at], context


def segmented(raw: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Groups of at most about SEGMENT bytes: text indexes, offsets, pieces. Pieces of a long text overlap by length - 1."""
    ids, offsets, pieces, size = [], [], [], 0
    for k, t in enumerate(raw):
        for a in range(0, max(1, len(t) - length + 1), SEGMENT):
            piece = t[a : a + SEGMENT + length - 1]
            if pieces and size + len(piece) > SEGMENT:
                yield ids, offsets, pieces
                ids, offsets, pieces, size = [], [], [], 0
            ids.append(k)
            offsets.append(a)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield ids, offsets, pieces


def runs(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching intervals of a key united; sorted by key and begin."""
    order = np.lexsort((begin, key))
    key, begin, end = key[order], begin[order], end[order]
    base = np.cumsum(np.append(False, key[1:] != key[:-1])) * (1 << 40)
    top = np.maximum.accumulate(end + base)
    first = np.append(True, begin[1:] + base[1:] > top[:-1])
    cut = np.flatnonzero(first)
    return key[cut], begin[cut], (top - base)[np.append(cut[1:] - 1, len(key) - 1)]


ANCHOR_SCHEMA = "h long, c long, d long, th long, at long, ends long"


def local(h, c, own, d, th, lo, hi, away, length: int) -> pa.RecordBatch:
    """Rows of ANCHOR_SCHEMA, copies settled: all but the earliest of equal (h, c) become intervals. own: the text, by its
    place in d and th."""
    dd, tt = d[own], th[own]
    order = np.lexsort((lo, tt, dd, c, h))
    again = np.zeros(len(order), bool)
    ho, co = h[order], c[order]
    again[1:] = (ho[1:] == ho[:-1]) & (co[1:] == co[:-1])
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    place = order[first]
    again &= (dd[order] != dd[place]) | (tt[order] != tt[place]) | (lo[order] != lo[place])
    drop, keep = order[again], np.sort(order[~again])
    columns = [h[keep], c[keep], dd[keep], tt[keep], lo[keep], (hi[keep] + 1) << 7 | away[keep]]
    if len(drop):
        k, a, b = runs(own[drop], lo[drop], hi[drop] + length)
        spread = mixed(d[k].astype(U) * U(BASE) + a.astype(U)).view(np.int64)
        columns = [np.concatenate(x) for x in zip(columns, (spread, np.zeros(len(k), np.int64), d[k], th[k], a, -b))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "c", "d", "th", "at", "ends"])


def anchors_of(length: int, gram: int):
    """Rows of contexts: anchor and context hash, document, text hash and start, and last start plus one with the anchor's
    distance in the lowest seven bits. Copies within a group of rows are settled here: all but the earliest become intervals
    (ends < 0: minus the end), dealt by a hash of their place."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, begin = 0, 0
            for k, t in enumerate(batch.column(2)):
                size += len(t.as_py() or "")
                if size >= GROUP or k == batch.num_rows - 1:
                    yield batch.slice(begin, k + 1 - begin)
                    size, begin = 0, k + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches):
            d = batch.column(0).to_numpy(zero_copy_only=False)
            th = batch.column(1).to_numpy(zero_copy_only=False)
            raw = [(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
            parts = []
            for ids, offsets, pieces in segmented(raw, length):
                doc, lo, hi, away, h, c = contexts(pieces, length, gram)
                own, off = np.array(ids, np.int64)[doc], np.array(offsets, np.int64)[doc]
                parts.append((own, lo + off, hi + off, away, h, c))
            if not parts:
                continue
            own, lo, hi, away, h, c = (np.concatenate(x) for x in zip(*parts))
            yield local(h.view(np.int64), c.view(np.int64), own, d, th, lo, hi, away, length)

    return emit


SETTLED_SCHEMA = "d long, th long, at long, ends long, h long"


def settled_of(length: int):
    """Of rows sorted by (h, c, d, th, at): intervals that repeat (h null), and one row of each ambiguous context."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the first row of the latest context: h, c, d, th, at, ends
        held = False  # it waits for a second context of its anchor
        for batch in batches:
            h, c, d, th, at, ends = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            done = ends < 0
            out_d, out_th, out_at, out_end, out_h = [d[done]], [th[done]], [at[done]], [-ends[done]], [h[done]]
            null = [np.ones(int(done.sum()), bool)]
            h, c, d, th, at, ends = (x[~done] for x in (h, c, d, th, at, ends))
            n = len(h)
            if n:
                if last is not None:
                    h, c, d, th, at, ends = (np.append(np.int64(v), x) for v, x in zip(last, (h, c, d, th, at, ends)))
                    n += 1
                seen = last is not None
                new_h = np.append(True, h[1:] != h[:-1])
                new_c = new_h | np.append(True, c[1:] != c[:-1])
                first = np.maximum.accumulate(np.where(new_c, np.arange(n), 0))
                again = ~new_c & ((d != d[first]) | (th != th[first]) | (at != at[first]))
                heads = np.flatnonzero(new_c)
                # A context is ambiguous if its anchor has another: the one before or the one after.
                other = np.zeros(len(heads), bool)
                same = h[heads[1:]] == h[heads[:-1]]
                other[1:] |= same
                other[:-1] |= same
                if seen and not held:
                    other[0] = False  # it has gone out, or repeats nothing new
                waiting = not other[-1] and (len(heads) > 1 or held or not seen)
                chosen = heads[other]
                out_d += [d[again], d[chosen]]
                out_th += [th[again], th[chosen]]
                out_at += [at[again], at[chosen]]
                out_end += [(ends[again] >> 7) - 1 + length, ends[chosen]]
                out_h += [h[again], h[chosen]]
                null += [np.ones(int(again.sum()), bool), np.zeros(len(chosen), bool)]
                k = int(heads[-1])
                last, held = (h[k], c[k], d[k], th[k], at[k], ends[k]), bool(waiting)
            arrays = [np.concatenate(x) for x in (out_d, out_th, out_at, out_end, out_h)]
            mask = np.concatenate(null)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x) for x in arrays[:4]), pa.array(arrays[4], mask=mask)], names=["d", "th", "at", "ends", "h"]
            )

    return emit


CUT_SCHEMA = "h long, d long, th long, at long, ends long, bytes binary"


def cut_of(length: int, gram: int):
    """The bytes of a document's ambiguous contexts by class, with the hash of the class's core; of repeated rows in a task, one."""
    half = (length - gram) // 2

    def pieces(raw: bytes, lo: int, ends: int) -> Iterator[tuple[int, int, bytes]]:
        hi = (ends >> 7) - 1
        anchor = lo + (ends & 127)
        if lo <= (last := min(hi, anchor - half)):
            yield lo, last, b"<" + raw[anchor - half : anchor + gram]
        if (first := max(lo, anchor - half + 1)) <= hi:
            yield first, hi, b">" + raw[anchor : anchor + length - half]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in sliced(batches):
            rows = []
            for d, th, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3)):
                if (d, th) in seen:
                    continue
                seen.add((d, th))
                raw = text.as_py() or b""
                for w in wanted.as_py():
                    for a, b, core in pieces(raw, w["at"], w["ends"]):
                        key = xxhash.xxh64_intdigest(core) - (1 << 63)
                        rows.append((key, d, th, a, b + 1, raw[a : b + length]))
            names = ["h", "d", "th", "at", "ends", "bytes"]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)

    return emit


def windows_of(length: int):
    """Rows of ANCHOR_SCHEMA for the single windows of a core's texts, dealt by window: h its hash, c the core. As in
    anchors_of, copies within a few thousand texts leave one row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, max(1, GROUP // (4 * length))):
            core, d, th, at, ends = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            raw = batch.column(5).to_pylist()
            if not raw:
                continue
            counts = ends - at
            sizes = np.array([len(t) for t in raw], np.int64)
            rolling = Rolling(np.frombuffer(b"".join(raw), np.uint8))
            own = np.repeat(np.arange(len(raw)), counts)
            away = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = (np.cumsum(sizes) - sizes)[own] + away
            h = rolling.of(begin, begin + length).view(np.int64)
            lo = at[own] + away
            yield local(h, core[own], own, d, th, lo, lo, np.zeros(len(own), np.int64), length)

    return emit


INTERVAL_SCHEMA = "d long, th long, at long, ends long"
#: Bytes move up by one, so that 0 ends texts only; UTF-8 has no byte above 244.
SHIFTED = bytes(min(k + 1, 255) for k in range(256))


class Shard:
    """Texts of whole cores on the task's disk: shifted bytes with 0 after each, and (d, th, at, ends, start) of each."""

    def __init__(self, directory: str):
        self.symbols = open(os.path.join(directory, "symbols"), "w+b")
        self.rows = open(os.path.join(directory, "rows"), "w+b")
        self.size = self.count = 0

    def add(self, d: int, th: int, at: int, ends: int, raw: bytes) -> None:
        self.rows.write(struct.pack("=5q", d, th, at, ends, self.size))
        self.symbols.write(raw.translate(SHIFTED) + b"\0")
        self.size += len(raw) + 1
        self.count += 1

    def cut_to(self, count: int, size: int) -> None:
        """Take back what came after."""
        self.count, self.size = count, size
        for f, end in ((self.rows, 40 * count), (self.symbols, size)):
            f.seek(end)
            f.truncate()

    def repeats(self, length: int, limit: int, base: int, directory: str) -> Iterator[pa.RecordBatch]:
        """Intervals that repeat: positions are marked in a map of the symbols and read back in order."""
        self.symbols.flush()
        self.rows.flush()
        scratch = Scratch(directory)
        symbols = np.asarray(np.memmap(self.symbols.name, np.uint8, "r", shape=(self.size,)))
        rows = np.asarray(np.memmap(self.rows.name, np.int64, "r", shape=(self.count, 5)))
        counted, gone = scratch.array(np.uint8, self.size), scratch.array(np.uint8, self.size)
        for k in range(0, self.count, ROWS):
            part = rows[k : k + ROWS]
            windows = part[:, 3] - part[:, 2]
            counted[np.repeat(part[:, 4] - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())] = 1
        for found in repeated(symbols, length, counted, limit, base, directory):
            gone[found] = 1
        for k in range(0, self.count, ROWS):
            part = np.array(rows[k : k + ROWS])
            low, high = int(part[0, 4]), int(rows[k + ROWS, 4]) if k + ROWS < self.count else self.size
            found = np.flatnonzero(gone[low:high]) + low
            if len(found):
                own = np.searchsorted(part[:, 4], found, "right") - 1
                begin = found - part[own, 4] + part[own, 2]
                own, begin, end = runs(own, begin, begin + length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part[own, 0], part[own, 1], begin, end)], names=["d", "th", "at", "ends"])


def sorted_of(length: int, shard: int = SHARD, limit: int = QUEUE, base: int = IN_MEMORY):
    """Intervals that repeat among texts sorted by (core, d, th, at): whole cores gather on disk up to about ``shard`` bytes, whose
    text is suffix-sorted. A core's texts lie in document order, so the earliest equal window is the least position. A text equal
    to an earlier one of its core repeats in full, unless it is the same place of a repeated row; so many are recognised at
    once, others in the sort."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as directory:
            held = Shard(directory)
            known: dict[bytes, tuple[int, int, int]] = {}  # texts of the open core and their first place
            core, begin, begin_size, last = None, 0, 0, None
            again: list[tuple[int, int, int, int]] = []
            for batch in batches:
                columns = [batch.column(k).to_pylist() for k in range(5)]
                for h, d, th, at, ends, text in zip(*columns, batch.column(5)):
                    if h != core:
                        if held.count - begin == 1:
                            held.cut_to(begin, begin_size)  # a core of one text repeats nothing
                        if held.size >= shard:
                            yield from held.repeats(length, limit, base, directory)
                            held.cut_to(0, 0)
                        known, core, begin, begin_size, last = {}, h, held.count, held.size, None
                    if last == (d, th, at):
                        continue
                    last = d, th, at
                    raw = text.as_py()
                    if raw in known:
                        again.append((d, th, at, ends - 1 + length))
                        continue
                    if len(known) < KNOWN:
                        known[raw] = last
                    held.add(d, th, at, ends, raw)
                if again:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in again], pa.int64()) for k in range(4)], names=["d", "th", "at", "ends"])
                    again = []
            if held.count - begin == 1:
                held.cut_to(begin, begin_size)
            if held.count:
                yield from held.repeats(length, limit, base, directory)

    return emit


RESULT_SCHEMA = "d long, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def finished_of(with_text: bool):
    """Counts and hash of what is left of each document; with_text also what is left, without characters cut apart, and any
    further columns as they are."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            d, th, n, removed, spans, digest, left = [], [], [], [], [], [], []
            for dk, tk, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3)):
                raw = text.as_py() or b""
                own = [(w["at"], w["ends"]) for w in found.as_py() or ()]
                merged: list[list[int]] = []
                for a, b in sorted(own):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                at, kept = 0, []
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                rest = b"".join(kept)
                d.append(dk)
                th.append(tk)
                n.append(len(raw))
                removed.append(len(raw) - len(rest))
                spans.append(len(merged))
                digest.append(hashlib.sha256(rest).hexdigest())
                left.append(rest)
            columns = [*(pa.array(x, pa.int64()) for x in (d, th, n, removed, spans)), pa.array(digest, pa.string())]
            names = ["d", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()))
                names.append("kept")
                for k in range(4, batch.num_columns):
                    columns.append(batch.column(k))
                    names.append(batch.schema.names[k])
            yield pa.RecordBatch.from_arrays(columns, names)

    return emit


def keyed(docs: DataFrame, *more) -> DataFrame:
    """d: doc_id, or the largest long if null; th: the text's hash, which tells texts of one doc_id apart."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id orders the documents and has to be an integer")
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    text = F.col("text").cast("string")
    return docs.select(d.alias("d"), F.xxhash64(text).alias("th"), text.alias("text"), *more)


def hot_cores(cut: DataFrame, length: int, most: int) -> DataFrame | None:
    """The cores (column core) whose texts have more than ``most`` bytes together; None if there are none. Only their number
    comes to the driver."""
    size = F.sum(F.col("ends") - F.col("at") + F.lit(length - 1))
    hot = materialize(cut.groupBy(F.col("h").alias("core")).agg(size.alias("size")).where(F.col("size") > most).select("core"), "hot")
    count = hot.count()
    if not count:
        return None
    return F.broadcast(hot) if count <= BROADCAST else hot


def repeats_among(cut: DataFrame, n: int, length: int, shard: int) -> DataFrame:
    """Intervals that repeat among the texts of cores. Cores of up to two shards are suffix-sorted; the windows of larger ones
    are dealt one by one, and of equal windows all but the earliest repeat."""
    hot = hot_cores(cut, length, 2 * shard)
    on = None if hot is None else F.col("h") == F.col("core")
    few = cut if hot is None else cut.join(hot, on, "left_anti")
    shards = few.repartition(n, "h").sortWithinPartitions("h", "d", "th", "at")
    again = shards.mapInArrow(sorted_of(length, shard), INTERVAL_SCHEMA)
    if hot is None:
        return again
    windows = cut.join(hot, on, "left_semi").mapInArrow(windows_of(length), ANCHOR_SCHEMA)
    dealt = windows.repartition(n, "h").sortWithinPartitions("h", "c", "d", "th", "at")
    return again.unionByName(dealt.mapInArrow(settled_of(length), SETTLED_SCHEMA).where("h IS NULL").drop("h"))


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, with_text: bool = False) -> DataFrame:
    """d, th, n_bytes, n_removed, n_spans, kept_sha256 of every document and, with_text, the kept text and the whole row."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(small_batches(docs))
    found = rows.mapInArrow(anchors_of(length, gram), ANCHOR_SCHEMA).repartition(n, "h").sortWithinPartitions("h", "c", "d", "th", "at")
    settled = materialize(found.mapInArrow(settled_of(length), SETTLED_SCHEMA), "contexts")
    same = (F.col("d") == F.col("wd")) & (F.col("th") == F.col("wt"))
    place = [F.col("d").alias("wd"), F.col("th").alias("wt")]
    wanted = settled.where("h IS NOT NULL").groupBy(*place).agg(F.collect_list(F.struct("h", "at", "ends")).alias("wanted"))
    cut = rows.join(wanted.hint("shuffle_hash"), same).select("d", "th", "text", "wanted").mapInArrow(cut_of(length, gram), CUT_SCHEMA)
    again = repeats_among(materialize(cut, "cut"), n, length, shard)
    intervals = settled.where("h IS NULL").select("d", "th", "at", "ends").unionByName(again)
    own = intervals.groupBy(*place).agg(F.collect_set(F.struct("at", "ends")).alias("found"))
    others = [c for c in docs.columns if c != "text"]
    whole = keyed(docs, F.struct(*others).alias("row")) if with_text else rows
    names = ["d", "th", "text", "found"] + ["row"] * with_text
    joined = whole.join(own.hint("shuffle_hash"), same, "left").select(names)
    schema = StructType.fromDDL(RESULT_SCHEMA)
    if with_text:
        schema = schema.add("kept", "string").add("row", joined.schema["row"].dataType)
    return joined.mapInArrow(finished_of(with_text), schema)


def cleaned_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs with repeated strings gone from the text (n_chars follows); what loses all its text is left out.

    Bytes of a character that a removal cut apart go with it.
    """
    done = deduplicated(docs, with_text=True, **options).where("n_removed = 0 OR kept <> ''")
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("bigint")}
    return done.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])


def doc_id_of(kind):
    return F.when(F.col("d") == LAST, F.lit(None)).otherwise(F.col("d")).cast(kind)


def op2(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    return deduplicated(docs).select(doc_id_of(kind).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
