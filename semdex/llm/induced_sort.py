"""Suffix order and common-prefix values of a text by external induced sorting with disk-backed queues.

Suffixes are of type S or L by their first change of symbol; leftmost S suffixes are sorted first, by naming the substrings
between them and sorting the text of names (by recursion, or in memory once it is short), and all others are induced: a pass
over growing symbols puts L suffixes, a pass over falling symbols S suffixes. Each pass takes tuples (position, common prefix
with the tuple before it) from a queue whose priority is the first symbol. Tuples of a symbol arrive in order, so a queue of
queues suffices; beyond a memory limit all its tuples go to a file as one run by symbol, and a symbol's tuples are taken from
the runs, older ones first. The common prefix of two tuples put into a queue one after the other is one more than the least
common prefix between the tuples that put them there.

Everything as long as the text is a file: symbols, types, leftmost positions, names and their order are memory maps, and what a
pass puts is appended to a file. The substrings are dealt by their next symbols to files until a file's are few enough to be
sorted in memory. So memory follows ``limit``, ``base`` and CHUNK, not the text.

Common prefixes are capped at ``depth``; suffixes that agree on ``depth`` symbols are in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np

CHUNK = 1 << 18
#: Files that substrings are dealt to at a time, about half of which hold equal ones.
SPLIT = 64


class Scratch:
    """Memory maps and files of one directory, under fresh names. A file has no name any more once it is mapped, so its space is
    free when the map is."""

    def __init__(self, directory: str):
        self.directory, self.made = directory, 0

    def path(self) -> str:
        self.made += 1
        return os.path.join(self.directory, str(self.made))

    def array(self, dtype, n: int) -> np.ndarray:
        """Zeros on disk."""
        if not n:
            return np.empty(0, dtype)
        path = self.path()
        out = np.asarray(np.memmap(path, dtype, "w+", shape=(n,)))
        os.remove(path)
        return out

    def written(self, path: str, dtype) -> np.ndarray:
        """What a file holds."""
        out = np.asarray(np.memmap(path, dtype, "r")) if os.path.getsize(path) else np.empty(0, dtype)
        os.remove(path)
        return out


def tuple_type(n: int, depth: int) -> np.dtype:
    """Position and common prefix, packed, for texts of n symbols."""
    return np.dtype([("pos", "<u4" if n < 1 << 32 else "<u8"), ("lcp", "<u1" if depth < 1 << 8 else "<u4")])


def as_tuples(kind: np.dtype, pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    out = np.empty(len(pos), kind)
    out["pos"], out["lcp"] = pos, lcp
    return out


class Run:
    """Tuples of a queue that went to disk together: symbols in the order of the pass, their offsets, and the tuples."""

    def __init__(self, scratch: Scratch, memory: dict[int, deque], symbols: list[int], kind: np.dtype, total: int):
        self.symbols, self.ends = scratch.array(np.int64, len(symbols)), scratch.array(np.int64, len(symbols))
        self.data, self.at, self.k = scratch.array(kind, total), 0, 0
        end = 0
        for k, s in enumerate(symbols):
            for part in memory[s]:
                self.data[end : end + len(part)] = part
                end += len(part)
            self.symbols[k], self.ends[k] = s, end

    def take(self, symbol: int) -> np.ndarray | None:
        if self.k == len(self.symbols) or self.symbols[self.k] != symbol:
            return None
        end = min(int(self.ends[self.k]), self.at + CHUNK)
        part = np.array(self.data[self.at : end])
        self.at = end
        if end == self.ends[self.k]:
            self.k += 1
        return part


class BucketQueue:
    """Tuples by first symbol, first in first out; beyond ``limit`` of them all go to a run on disk. Symbols are taken in one
    direction, and no tuple comes to a symbol that has been passed."""

    def __init__(self, scratch: Scratch, limit: int, kind: np.dtype, falling: bool = False):
        self.scratch, self.limit, self.kind, self.falling = scratch, limit, kind, falling
        self.memory: dict[int, deque] = defaultdict(deque)
        self.runs: list[Run] = []
        self.total = self.spilled = 0

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.memory[symbol].append(as_tuples(self.kind, pos, lcp))
        self.total += len(pos)
        if self.total > self.limit:
            self.runs = [r for r in self.runs if r.k < len(r.symbols)]
            self.runs.append(Run(self.scratch, self.memory, sorted(self.memory, reverse=self.falling), self.kind, self.total))
            self.spilled += self.total
            self.memory.clear()
            self.total = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next tuples of a symbol, or None."""
        part = next((p for r in self.runs if (p := r.take(symbol)) is not None), None)
        if part is None:
            waiting = self.memory.get(symbol)
            if not waiting:
                self.memory.pop(symbol, None)
                return None
            parts, size = [], 0
            while waiting and size < CHUNK:
                parts.append(waiting.popleft())
                size += len(parts[-1])
            part = np.concatenate(parts)
            self.total -= len(part)
        return part["pos"].astype(np.int64), part["lcp"].astype(np.int64)


class Sequence:
    """Tuples in the order they are put, on disk, with the place of each symbol's."""

    def __init__(self, scratch: Scratch, kind: np.dtype, symbols: int):
        self.scratch, self.path, self.kind, self.size = scratch, scratch.path(), kind, 0
        self.file = open(self.path, "wb")
        self.begin, self.end = scratch.array(np.int64, symbols), scratch.array(np.int64, symbols)

    def add(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        if self.begin[symbol] == self.end[symbol]:
            self.begin[symbol] = self.size
        self.file.write(as_tuples(self.kind, pos, lcp).tobytes())
        self.size += len(pos)
        self.end[symbol] = self.size

    def close(self) -> Sequence:
        self.file.close()
        self.data = self.scratch.written(self.path, self.kind)
        return self

    def read(self, symbol: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = int(self.begin[symbol]), int(self.end[symbol])
        cuts = list(range(a, b, CHUNK))
        for k in reversed(cuts) if backwards else cuts:
            part = np.array(self.data[k : min(b, k + CHUNK)])
            yield part["pos"].astype(np.int64), part["lcp"].astype(np.int64)


class Text:
    """Symbols on disk, most significant byte first, so that 64 bits from any symbol on are one number; zero beyond the end."""

    def __init__(self, scratch: Scratch, symbols: np.ndarray, bits: int):
        self.bits, self.per = bits, 64 // bits
        n, width = len(symbols), bits // 8
        raw = scratch.array(np.uint8, n * width + 8)
        self.t = raw[: n * width].view(f">u{width}")
        for k in range(0, n, CHUNK):
            self.t[k : k + CHUNK] = symbols[k : k + CHUNK]
        self.word = np.ndarray((n + 1,), ">u8", raw, strides=(width,))

    def words(self, at: np.ndarray) -> np.ndarray:
        return self.word[np.minimum(at, len(self.t))].astype(np.uint64)

    def common(self, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
        """Common prefix lengths of suffix pairs, at most cap."""
        out = np.zeros(len(a), np.int64)
        active = np.arange(len(a))
        n = len(self.t)
        for done in range(0, cap, self.per):
            x, y = a[active] + done, b[active] + done
            diff = self.words(x) ^ self.words(y)
            same = np.zeros(len(active), np.int64)
            for k in range(1, self.per + 1):
                same += (diff < np.uint64(1 << (64 - self.bits * k))) if k < self.per else (diff == 0)
            out[active] = np.minimum(done + same, n - np.maximum(a[active], b[active]))
            active = active[(same == self.per) & (out[active] == done + self.per)]
            if not len(active):
                break
        return np.minimum(out, cap)


def types(t: np.ndarray, scratch: Scratch) -> np.ndarray:
    """1 for S suffixes, from the end in chunks. The last symbol is less than any other, or equal to symbols that larger ones
    stand before."""
    n = len(t)
    s = scratch.array(np.uint8, n)
    s[n - 1] = 1
    for end in range(n - 1, 0, -CHUNK):
        begin = max(0, end - CHUNK)
        own, following = t[begin:end], t[begin + 1 : end + 1]
        m = end - begin
        at = np.where(own != following, np.arange(m), m)
        at = np.minimum.accumulate(at[::-1])[::-1]
        grows = np.append(following > own, bool(s[end]))
        s[begin:end] = grows[at]
    return s


def leftmost(s: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Positions of S suffixes after an L suffix."""
    path = scratch.path()
    with open(path, "wb") as f:
        for k in range(1, len(s), CHUNK):
            own, before = s[k : k + CHUNK], s[k - 1 : min(len(s), k + CHUNK) - 1]
            f.write((np.flatnonzero(own & ~before & 1) + k).astype(np.int64).tobytes())
    return scratch.written(path, np.int64)


def refined(order_rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split groups of equal rank by a key: rank is the place of a group's first member. Returns who is still tied."""
    by = np.lexsort((key, order_rank[active]))
    own, k = active[by], key[by]
    old = order_rank[own]
    new_group = np.append(True, old[1:] != old[:-1])
    index = np.arange(len(own))
    begin = np.maximum.accumulate(np.where(new_group, index, 0))
    split = new_group | np.append(True, k[1:] != k[:-1])
    sub = np.maximum.accumulate(np.where(split, index, 0))
    order_rank[own] = old + (sub - begin)
    size = np.diff(np.append(np.flatnonzero(split), len(own)))
    return order_rank, own[np.repeat(size > 1, size)]


def first_ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rank = np.zeros(len(key), np.int64)
    return refined(rank, np.arange(len(key)), key)


def substring_groups(text: Text, lms: np.ndarray, scratch: Scratch, base: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places in lms, but the last, by the substrings from each to the next, and where a new substring begins.

    At most ``base`` are sorted at once; more are dealt to files by the 64 bits at hand: between splitters of a sample, and
    equal to one, whose next 64 bits count.
    """
    per, full = text.per, np.uint64(0xFFFFFFFFFFFFFFFF)

    def length(which: np.ndarray) -> np.ndarray:
        return lms[which + 1] - lms[which] + 1

    def key(which: np.ndarray, done: int) -> np.ndarray:
        left = np.clip(length(which) - done, 0, per)
        # Symbols beyond a substring's end count as larger than any.
        fill = np.where(left >= per, np.uint64(0), full >> (np.minimum(left, per - 1) * text.bits).astype(np.uint64))
        return text.words(lms[which] + done) | fill

    def chunks(which: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(0, len(which), CHUNK):
            yield np.array(which[k : k + CHUNK])

    waiting: list[tuple[np.ndarray, int, bool]] = [(np.arange(len(lms) - 1) if len(lms) - 1 <= base else _counting(len(lms) - 1, scratch), 0, False)]
    while waiting:
        which, done, equal = waiting.pop()
        if equal:
            # All are the same substring, in the order of the text.
            for k, part in enumerate(chunks(which)):
                yield part, np.append(k == 0, np.zeros(len(part) - 1, bool))
        elif len(which) <= base:
            which = np.array(which)
            rank, tied = first_ranks(key(which, done))
            size = length(which)
            at = done + per
            while len(tied) and at < size.max():
                rank, tied = refined(rank, tied, key(which[tied], at))
                tied = tied[np.isin(rank[tied], rank[tied][size[tied] > at + per])] if len(tied) else tied
                at += per
            by = np.argsort(rank, kind="stable")
            r = rank[by]
            yield which[by], np.append(True, r[1:] != r[:-1])
        else:
            sample = key(np.array(which[:: max(1, len(which) // 8192)]), done)
            splitters = np.unique(np.sort(sample)[:: max(1, len(sample) // (SPLIT // 2))])
            paths = [scratch.path() for _ in range(2 * len(splitters) + 1)]
            files = [open(p, "wb") for p in paths]
            for part in chunks(which):
                k = key(part, done)
                place = np.searchsorted(splitters, k, "left")
                bucket = 2 * place + (splitters[np.minimum(place, len(splitters) - 1)] == k)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(len(files) + 1))
                for b in np.flatnonzero(np.diff(cuts)):
                    files[b].write(part[by[cuts[b] : cuts[b + 1]]].astype(np.int64).tobytes())
            for f in files:
                f.close()
            for b in reversed(range(len(paths))):
                own = scratch.written(paths[b], np.int64)
                if len(own):
                    ended = b % 2 == 1 and int(length(own[:1])[0]) <= done + per
                    waiting.append((own, done + per * (b % 2), ended))


def _counting(n: int, scratch: Scratch) -> np.ndarray:
    out = scratch.array(np.int64, n)
    for k in range(0, n, CHUNK):
        out[k : k + CHUNK] = np.arange(k, min(n, k + CHUNK))
    return out


def sorted_leftmost(text: Text, lms: np.ndarray, depth: int, scratch: Scratch, limit: int, base: int) -> np.ndarray:
    """The leftmost S positions in suffix order."""
    n = len(lms)
    if n <= 1:
        return lms
    # The last one begins with the text's last symbol and is less than all others.
    by, names = scratch.array(np.int64, n), scratch.array(np.uint32, n)
    by[0], at, name = n - 1, 1, 0
    for which, new in substring_groups(text, lms, scratch, base):
        own = name + np.cumsum(new)
        by[at : at + len(which)] = which
        names[which] = own
        at, name = at + len(which), int(own[-1])
    order = scratch.array(np.int64, n)
    if name == n - 1:
        for k in range(0, n, CHUNK):
            order[k : k + CHUNK] = lms[by[k : k + CHUNK]]
    elif n <= base:
        rank, tied = first_ranks(np.array(names))
        step = 1
        while len(tied) and step < depth:
            after = tied + step
            rank, tied = refined(rank, tied, np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0))
            step *= 2
        order[:] = lms[np.argsort(rank, kind="stable")]
    else:
        at = 0
        for pos, _ in suffix_order(names, 32, depth, scratch.directory, limit, base, scratch):
            order[at : at + len(pos)] = lms[pos]
            at += len(pos)
    return order


def induce(text: Text, s: np.ndarray, pos: np.ndarray, lcp: np.ndarray, wanted: bool, queue: BucketQueue, since: dict[int, int], cap: int) -> None:
    """Put the wanted predecessors of a run of tuples into the queue; since: by symbol, the least lcp since its last tuple."""
    before = np.maximum(pos - 1, 0)
    chosen = np.flatnonzero((pos > 0) & (s[before] == wanted))
    tail = np.minimum.accumulate(lcp[::-1])[::-1]
    whole = int(tail[0])
    fresh: dict[int, int] = {}
    if len(chosen):
        symbols = text.t[before[chosen]]
        by = np.argsort(symbols, kind="stable")
        chosen, symbols = chosen[by], symbols[by]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for own in np.split(chosen, cuts):
            symbol = int(text.t[before[own[0]]])
            out = np.empty(len(own), np.int64)
            out[0] = min(since.get(symbol, 0), int(lcp[: own[0] + 1].min()))
            if len(own) > 1:
                out[1:] = np.minimum.reduceat(lcp[: own[-1] + 1], own[:-1] + 1)
            queue.push(symbol, before[own], np.minimum(out + 1, cap))
            fresh[symbol] = int(tail[own[-1] + 1]) if own[-1] + 1 < len(lcp) else cap
    for symbol in since:
        since[symbol] = min(since[symbol], whole)
    since.update(fresh)


def suffix_order(
    symbols: np.ndarray, bits: int, depth: int, directory: str, limit: int = 1 << 24, base: int = 1 << 22, scratch: Scratch | None = None, watch: Callable[[int], None] = lambda spilled: None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of (positions, common prefix with the one before) of all suffixes in order.

    The last symbol is less than all but its equals, and no two of these stand side by side. ``limit``: tuples a queue holds
    in memory; ``base``: the most substrings, and the longest text of names, that are sorted in memory; watch is told how many
    tuples each pass spilled.
    """
    n = len(symbols)
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int64)
        return
    scratch = scratch or Scratch(directory)
    text = Text(scratch, symbols, bits)
    s = types(text.t, scratch)
    order = sorted_leftmost(text, leftmost(s, scratch), depth, scratch, limit, base)
    top = max(int(text.t[k : k + CHUNK].max()) for k in range(0, n, CHUNK)) + 1
    have, of_leftmost = scratch.array(np.uint8, top), scratch.array(np.int64, top + 1)
    for k in range(0, n, CHUNK):
        have[np.unique(text.t[k : k + CHUNK])] = 1
    for k in range(0, len(order), CHUNK):
        found, count = np.unique(text.t[order[k : k + CHUNK]], return_counts=True)
        of_leftmost[found.astype(np.int64) + 1] += count
    for k in range(0, top + 1, CHUNK):
        of_leftmost[k : k + CHUNK] = np.cumsum(of_leftmost[k : k + CHUNK]) + (of_leftmost[k - 1] if k else 0)

    def alphabet(backwards: bool = False) -> Iterator[int]:
        for k in sorted(range(0, top, CHUNK), reverse=backwards):
            own = np.flatnonzero(have[k : k + CHUNK]) + k
            yield from (own[::-1] if backwards else own).tolist()

    def one(a: int, b: int) -> int:
        return int(text.common(np.array([a]), np.array([b]), depth)[0])

    def turned(pos: np.ndarray, lcp: np.ndarray, carried: int | None, last: int | None) -> tuple[np.ndarray, np.ndarray]:
        """A part read backwards, in falling order: its common prefixes move by one; carried: that of the part before."""
        out = np.empty(len(pos), np.int64)
        out[1:] = lcp[:0:-1]
        out[0] = carried if carried is not None else one(last, int(pos[-1])) if last is not None else 0
        return pos[::-1], out

    kind = tuple_type(n, depth)
    queue, stored = BucketQueue(scratch, limit, kind), Sequence(scratch, kind, top)
    for c in alphabet():
        since: dict[int, int] = {}
        last = None
        while (run := queue.pop(c)) is not None:
            pos, lcp = run
            if last is None:
                lcp[0] = 0
            stored.add(c, pos, lcp)
            induce(text, s, pos, lcp, False, queue, since, depth)
            last = int(pos[-1])
        a, b = int(of_leftmost[c]), int(of_leftmost[c + 1])
        for k in range(a, b, CHUNK):
            pos = np.array(order[k : min(b, k + CHUNK)])
            before = np.array(order[max(a, k - 1) : k - 1 + len(pos)])
            lcp = np.zeros(len(pos), np.int64)
            lcp[len(pos) - len(before) :] = text.common(before, pos[len(pos) - len(before) :], depth)
            if k == a:
                lcp[0] = one(last, int(pos[0])) if last is not None else 0
            induce(text, s, pos, lcp, False, queue, since, depth)
    watch(queue.spilled)
    stored.close()
    queue, falling = BucketQueue(scratch, limit, kind, True), Sequence(scratch, kind, top)
    for c in alphabet(backwards=True):
        since = {}
        last = None
        while (run := queue.pop(c)) is not None:
            pos, lcp = run
            if last is None:
                lcp[0] = 0
            falling.add(c, pos, lcp)
            induce(text, s, pos, lcp, True, queue, since, depth)
            last = int(pos[-1])
        carried = None
        for pos, lcp in stored.read(c, backwards=True):
            own, common = turned(pos, lcp, carried, last)
            carried = int(lcp[0])
            induce(text, s, own, common, True, queue, since, depth)
    watch(queue.spilled)
    falling.close()
    yield np.array([n - 1]), np.zeros(1, np.int64)
    for c in alphabet():
        last = n - 1 if c == int(text.t[n - 1]) else None
        for pos, lcp in stored.read(c):
            yield pos, lcp
            last = int(pos[-1])
        carried = None
        for pos, lcp in falling.read(c, backwards=True):
            own, common = turned(pos, lcp, carried, last)
            carried = int(lcp[0])
            yield own, common


def repeated(symbols: np.ndarray, length: int, counted: np.ndarray, limit: int = 1 << 24, base: int = 1 << 22, directory: str | None = None, watch: Callable[[int], None] = lambda spilled: None) -> Iterator[np.ndarray]:
    """Counted positions whose first ``length`` symbols also start at an earlier counted position, over symbols 1 to 254 with
    0 after each string. A counted position has ``length`` symbols of its string from it on. Of a group of equal strings only
    the least position so far is held."""
    with tempfile.TemporaryDirectory(dir=directory) as at:
        least = np.empty(0, np.int64)  # of the group that is open
        for pos, lcp in suffix_order(symbols, 8, length, at, limit, base, watch=watch):
            group = np.cumsum(lcp < length)
            mine = counted[pos] != 0
            p, g = np.concatenate([least, pos[mine]]), np.concatenate([np.zeros(len(least), np.int64), group[mine]])
            least = np.empty(0, np.int64)
            if len(p):
                starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                lowest = np.minimum.reduceat(p, starts)
                yield p[p != np.repeat(lowest, np.diff(np.append(starts, len(p))))]
                if g[-1] == group[-1]:
                    least = lowest[-1:]
