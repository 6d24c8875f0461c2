"""Exact top-k by inner product with M-trees searched best first.

Components become integers floor(1024 * x). Inner product is no metric, so a tree holds each vector with one more coordinate
that makes all of its norms equal; the nearest of these in Euclidean distance has the highest inner product with a query,
whose own extra coordinate is zero. Nodes are pages: entries keep their distance to the page's pivot and, for inner pages,
their covering radius. A search takes pages by their least possible distance; |d(q, parent) - d(entry, parent)| rules
entries out before their own distance is computed. Scores of surviving entries are exact integers.

The tree's top level is spread over tasks. Its pivots are a bounded sample of the rows; each row goes to its nearest pivot, and
each pivot's rows are built into trees of at most about ``block_rows`` rows, once. A query is first searched in its own pivot's
tree, whose k-th score bounds the rest; it is then sent only to the trees that the bound does not rule out by
d(q, pivot) - radius. Trees stay where they are and queries stream by, so memory is that of one tree.

Defined cases: rows with a null id, a null or empty vector, or null or non-finite components take no part; shorter vectors count as
padded with zeros; a row with the query's own id is not its answer; repeated rows of a query are one query, repeated
candidates count each; a component beyond 2**62 or a score beyond a long is an error; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semdex.llm.common import materialize

SCALE = 1024
PAGE = 128
FANOUT = 12
SEED = 11
#: Bounds of the top level: pivots, rows of the sample they and their shares come from, bytes of either, bytes of a tree's vectors.
MAX_PIVOTS = 4096
SAMPLE_ROWS = 8192
SAMPLE_BYTES = 16 << 20
TREE_BYTES = 16 << 20
LEAST_TREE = 256
#: Pivots to begin with, so that small tables also spread over tasks.
FEW_PIVOTS = 64
#: Share of |q|**2 + the largest norm**2 that squared distances may be off by in double arithmetic.
SLACK = 1e-12


@dataclass
class Page:
    """pivots, radii and to_parent describe child pages, or rows (a slice of the tree's vectors) and to_parent the vectors of a leaf."""

    pivots: np.ndarray | None
    radii: np.ndarray | None
    to_parent: np.ndarray
    children: list
    rows: np.ndarray | None


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the coordinate that makes their squared norms ``top``."""
    wide = vectors.astype(np.float64)
    return np.concatenate([wide, np.sqrt(np.maximum(top - (wide**2).sum(axis=1), 0))[:, None]], axis=1)


def reach(query: np.ndarray, top: float, score: float | None) -> float:
    """The distance within which vectors of at least a score lie; the slack is for rounding."""
    if score is None:
        return np.inf
    whole = float((query.astype(np.float64) ** 2).sum()) + top
    return float(np.sqrt(max(0.0, whole - 2.0 * score) + SLACK * whole)) * (1 + 1e-9) + 1e-6


class MTree:
    """top: the squared norm all vectors are lifted to (at least their largest); root: the pivot of the root page."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, fanout: int = FANOUT, top: float | None = None, root: np.ndarray | None = None):
        self.ids, self.vectors, self.page, self.fanout = ids, vectors, page, fanout
        squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.top = top if top is not None else float(squares.max()) if len(squares) else 0.0
        self.points = lifted(vectors, self.top)
        self.rng = np.random.default_rng(1)
        self.root_pivot = root if root is not None else self.points.mean(axis=0) if len(ids) else np.zeros(vectors.shape[1] + 1)
        self.computed = 0
        self.root = self._build(np.arange(len(ids)), self.root_pivot)
        self.radius = float(np.linalg.norm(self.points - self.root_pivot, axis=1).max()) if len(ids) else 0.0
        del self.points

    def _build(self, rows: np.ndarray, pivot: np.ndarray) -> Page:
        points = self.points[rows]
        if len(rows) <= self.page:
            return Page(None, None, np.linalg.norm(points - pivot, axis=1), [], rows)
        chosen = points[self.rng.choice(len(rows), self.fanout, replace=False)]
        distance = np.stack([np.linalg.norm(points - c, axis=1) for c in chosen], axis=1)
        nearest = distance.argmin(axis=1)
        groups = [np.flatnonzero(nearest == k) for k in range(self.fanout)]
        if max(map(len, groups)) > 0.9 * len(rows):
            # Nearly all rows coincide for these pivots: halves of any order are as good, and the depth stays logarithmic.
            order = np.argsort(distance[:, 0], kind="stable")
            groups = np.array_split(order, 2)
            chosen = np.stack([points[g[0]] for g in groups])
        kept = [(c, g) for c, g in zip(chosen, groups) if len(g)]
        pivots = np.stack([c for c, _ in kept])
        radii = np.array([np.linalg.norm(points[g] - c, axis=1).max() for c, g in kept])
        return Page(pivots, radii, np.linalg.norm(pivots - pivot, axis=1), [self._build(rows[g], c) for c, g in kept], None)

    def search(self, query: np.ndarray, k: int, own: int | None = None, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), higher scores first, ties to the smaller id, of those with at least the score ``least``; rows
        with the id ``own`` are left out."""
        if not len(self.ids):
            return []
        q = np.append(query.astype(np.float64), 0.0)
        wide = bool((q @ q) * self.top >= 2.0**124)
        best: list[tuple[int, int]] = []
        limit = reach(query, self.top, least)
        queue: list[tuple[float, int, float, Page]] = [(0.0, 0, float(np.linalg.norm(q - self.root_pivot)), self.root)]
        turn = 1
        while queue:
            low, _, d, page = heapq.heappop(queue)
            if low > limit:
                break
            if page.rows is None:
                open_ = np.flatnonzero(np.abs(d - page.to_parent) - page.radii <= limit)
                if len(open_):
                    own_d = np.linalg.norm(page.pivots[open_] - q, axis=1)
                    self.computed += len(open_)
                    for i, di in zip(open_.tolist(), own_d.tolist()):
                        near = max(low, di - page.radii[i])
                        if near <= limit:
                            heapq.heappush(queue, (near, turn, di, page.children[i]))
                            turn += 1
                continue
            rows = page.rows[np.abs(d - page.to_parent) <= limit]
            if not len(rows):
                continue
            if wide and np.abs(self.vectors[rows].astype(np.float64) @ q[:-1]).max() >= 2.0**63 * (1 - SLACK):
                raise OverflowError("a score is beyond a long")
            # Sums modulo 2**64 are the true ones where these fit a long.
            scores = self.vectors[rows] @ query
            self.computed += len(rows)
            floor = best[-1][0] if len(best) == k else least
            if floor is not None:
                close = scores >= floor
                rows, scores = rows[close], scores[close]
            found = [(s, i) for s, i in zip(scores.tolist(), self.ids[rows].tolist()) if i != own]
            if found:
                best = heapq.nsmallest(k, best + found, key=lambda x: (-x[0], x[1]))
                if len(best) == k:
                    limit = min(limit, reach(query, self.top, best[-1][0]))
        return best


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of an Arrow list array, padded with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def sampled(rows: DataFrame, dims: int) -> np.ndarray:
    """At most SAMPLE_ROWS vectors, and no more than SAMPLE_BYTES, those of the least seeded hash."""
    limit = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
    found = rows.select("v").orderBy(F.xxhash64(F.lit(SEED), "vec_id", "v"), "v").limit(limit).toArrow()
    return matrix(found.column("v").combine_chunks(), dims)


@dataclass(frozen=True)
class TopLevel:
    """Pivots of the top level (lifted) and into how many parts each pivot's rows are dealt."""

    pivots: np.ndarray
    parts: np.ndarray
    top: float
    dims: int

    def distances(self, points: np.ndarray) -> np.ndarray:
        squares = (points**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * (points @ self.pivots.T)
        return np.sqrt(np.maximum(squares, 0))

    def nearest(self, points: np.ndarray) -> np.ndarray:
        step = max(1, (1 << 22) // len(self.pivots))
        return np.concatenate([np.empty(0, np.int64), *(self.distances(points[k : k + step]).argmin(axis=1) for k in range(0, len(points), step))])


def top_level(rows: DataFrame, n: int, dims: int, top: float, block_rows: int) -> TopLevel:
    """Every few rows of the sample are pivots; the sample's shares tell how many parts a pivot needs."""
    sample = lifted(sampled(rows, dims), top)
    wanted = max(-(-n // block_rows), min(FEW_PIVOTS, -(-n // LEAST_TREE)))
    pivots = np.unique(sample[: max(1, min(wanted, MAX_PIVOTS, len(sample)))], axis=0)
    found = TopLevel(pivots, np.ones(len(pivots), np.int64), top, dims)
    share = np.bincount(found.nearest(sample), minlength=len(pivots)) / max(1, len(sample))
    # A pivot with more than an even share is dealt out as well, so that no task has a hot one whole.
    return TopLevel(pivots, np.maximum(1, np.ceil(share * n / min(block_rows, -(-n // wanted)))).astype(np.int64), top, dims)


PLACED = "page int, part int, asked boolean, vec_id long, v array<long>"


def placed_by(level: TopLevel):
    """Nearest pivot and part of rows (asked, vec_id, v, h: a hash)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page = level.nearest(lifted(matrix(batch.column(2), level.dims), level.top))
            part = batch.column(3).to_numpy(zero_copy_only=False) % level.parts[page]
            yield pa.RecordBatch.from_arrays(
                [pa.array(page, pa.int32()), pa.array(part, pa.int32()), batch.column(0), batch.column(1), batch.column(2)],
                names=["page", "part", "asked", "vec_id", "v"],
            )

    return emit


BUILT = (
    "tree long, page int, radius double, body binary, query_id long, v array<long>, least long, found array<struct<score: long, vec_id: long>>"
)
FOUND = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))


def built_of(level: TopLevel, k: int, block_rows: int):
    """Of rows sorted by (page, part, asked): a row for each tree and, after a part's trees, a row for each query with what the last
    of them holds for it and the k-th score."""
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), FOUND]
    names = ["tree", "page", "radius", "body", "query_id", "v", "least", "found"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple[int, int] | None = None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        tree: MTree | None = None
        last: tuple[int, np.ndarray] | None = None  # the latest query; repeated rows follow each other
        number = held = 0

        def rows(*values: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*values), kinds)], names=names)

        def tree_id() -> int:
            return here[0] << 44 | here[1] << 22 | (number - 1)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal tree, number, held, ids, vectors
            if held:
                tree = MTree(np.concatenate(ids), np.concatenate(vectors), top=level.top, root=level.pivots[here[0]])
                number += 1
                yield rows((tree_id(), here[0], tree.radius, pickle.dumps(tree, 5), None, None, None, None))
                ids, vectors, held = [], [], 0

        for batch in batches:
            page, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            asked = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero((np.diff(page) != 0) | (np.diff(part) != 0) | (np.diff(asked) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(page)]):
                if a == b:
                    continue
                if here != (now := (int(page[a]), int(part[a]))):
                    yield from close()
                    here, tree, number, last = now, None, 0, None
                own, v = batch.column(3).slice(a, b - a).to_numpy(), matrix(batch.column(4).slice(a, b - a), level.dims)
                if asked[a]:
                    yield from close()
                    out = []
                    for query_id, q in zip(own.tolist(), v):
                        if last is not None and last[0] == query_id and np.array_equal(last[1], q):
                            continue
                        last = query_id, q
                        best = tree.search(q, k, query_id) if tree else []
                        least = best[-1][0] if len(best) == k else None
                        home = tree_id() if tree else None
                        out.append((home, here[0], None, None, query_id, q.tolist(), least, [{"score": s, "vec_id": i} for s, i in best]))
                    if out:
                        yield rows(*out)
                    continue
                for c in range(0, b - a, block_rows):
                    ids.append(own[c : c + block_rows])
                    vectors.append(v[c : c + block_rows])
                    held += len(ids[-1])
                    if held >= block_rows:
                        yield from close()
        yield from close()

    return emit


def routed_by(level: TopLevel, radii: np.ndarray):
    """The pages a query's bound leaves: (page, distance to its pivot, reach) for rows (query_id, v, least, tree)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(0, batch.num_rows, 256):
                own = batch.slice(c, 256)
                v = matrix(own.column(1), level.dims)
                d = level.distances(np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], axis=1))
                limit = np.array([reach(q, level.top, s) for q, s in zip(v, own.column(2).to_pylist())])
                whole = (v.astype(np.float64) ** 2).sum(axis=1) + level.top
                # Distances from a matrix product are off by as much as the squares are.
                limit = limit + np.sqrt(SLACK * 4 * whole)
                at, page = np.nonzero(d - radii <= limit[:, None])
                picked = own.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns, pa.array(page, pa.int32()), pa.array(d[at, page]), pa.array(limit[at])],
                    names=["query_id", "v", "least", "home", "page", "d", "reach"],
                )

    return emit


HITS = "query_id long, vec_id long, score long"


def searched_of(level: TopLevel, k: int):
    """Of rows sorted by (tree, body nulls last): the tree, then the queries that come to it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: MTree | None = None
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            v = None
            for r, (body, query_id, least) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(4).to_pylist())):
                if body.is_valid:
                    tree = pickle.loads(body.as_py())
                    continue
                if v is None:
                    v = matrix(batch.column(3), level.dims)
                found += [(query_id, i, s) for s, i in tree.search(v[r], k, query_id, least)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return emit


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 32768) -> DataFrame:
    """query_id, rank, vec_id, score for integer vectors: rows and queries have columns vec_id and v (array<long>).

    Jobs: one for counts and norms, one for the sample, one that builds the trees and searches each query's own, and the last.
    """
    spark = rows.sparkSession
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, dims, top = rows.unionByName(queries.select(*rows.columns)).agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(squares)).head()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    block_rows = max(1, min(block_rows, TREE_BYTES // (8 * dims)))
    level = top_level(rows, n, dims, float(top), block_rows)
    hashed = F.pmod(F.xxhash64(F.lit(SEED + 1), "vec_id"), F.lit(1 << 30)).cast("long").alias("h")
    both = rows.select(F.lit(False).alias("asked"), "vec_id", "v", hashed).unionByName(queries.select(F.lit(True).alias("asked"), "vec_id", "v", hashed))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = both.mapInArrow(placed_by(level), PLACED).repartition(parts, "page", "part").sortWithinPartitions("page", "part", "asked", "vec_id", "v")
    built = materialize(placed.mapInArrow(built_of(level, k, block_rows), BUILT), "trees")
    trees = built.where("body IS NOT NULL")
    # A row for each pivot, at most MAX_PIVOTS.
    radii = np.full(len(level.pivots), -np.inf)
    for r in trees.groupBy("page").agg(F.max("radius").alias("radius")).collect():
        radii[r["page"]] = r["radius"]
    asked = built.where("query_id IS NOT NULL").select("query_id", "v", "least", F.col("tree").alias("home"))
    routes = asked.mapInArrow(routed_by(level, radii), "query_id long, v array<long>, least long, home long, page int, d double, reach double")
    places = trees.select("tree", F.col("page").alias("tree_page"), "radius")
    sent = routes.join(places, (F.col("page") == F.col("tree_page")) & (F.col("d") - F.col("radius") <= F.col("reach")) & ~F.col("tree").eqNullSafe(F.col("home")))
    no_body = F.lit(None).cast("binary").alias("body")
    line = trees.select("tree", "body", "query_id", "v", "least").unionByName(sent.select("tree", no_body, "query_id", "v", "least"))
    met = line.repartition(parts, "tree").sortWithinPartitions("tree", F.col("body").isNull()).mapInArrow(searched_of(level, k), HITS)
    home = built.where("query_id IS NOT NULL").select("query_id", F.explode("found").alias("f")).select("query_id", "f.vec_id", "f.score")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.unionByName(home).withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame) -> DataFrame:
    """Rows that take part, with integer components."""
    x = F.col("embedding")
    valid = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def whole(c):
        scaled = F.floor(c.cast("double") * SCALE).cast("bigint")
        return F.when(F.abs(c.cast("double")) < 2.0**52, scaled).otherwise(F.raise_error(F.lit("a component is beyond 2**62")).cast("bigint"))

    return embeddings.where(F.coalesce(valid, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, whole).alias("v"))


def op10(embeddings: DataFrame) -> DataFrame:
    rows = quantised(embeddings)
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]))::BIGINT AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""
