"""Hilbert-curve ordering of documents into equal-count shards, with DataFrame functions only.

Three metadata dimensions (text size, language, source) are quantised to 2**bits cells at quantiles of the rows, strings in
the order of their whole UTF-8 bytes; cells are visited along a Hilbert curve, and the curve is cut into runs whose row counts differ
by at most one. A run covers a compact box of the metadata space, so min/max statistics of its files prune filters on
any of the dimensions.

Quantiles of a string dimension come from its distinct values, counted, dealt by ranges and summed along the ranges; only the
cells' bounds come to the driver. Ranks are global yet no task sees an unbounded group: cells are split into hash sub-groups of bounded size, a table of
at most ``cells + max_groups`` group counts is summed along the curve, and rows are numbered within their group.

Defined cases: null text has size 1 and the checksum of the empty text; null lang or source sorts first; rows of null
doc_id are spread over sub-groups by their place in the input, others by id, size and checksum; repeated rows are numbered
separately; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semdex.llm.common import materialize, release

DIMS = 3


def curve_tables(dims: int = DIMS) -> tuple[list[int], list[int]]:
    """Next state and output digit of the curve's automaton, indexed by state * 2**dims + label.

    A state is (entry corner, direction); the step is the Gray-code construction of compact Hilbert indices.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def rotate(x: int, k: int) -> int:
        k %= dims
        return ((x << k) | (x >> (dims - k))) & mask

    def trailing_ones(i: int) -> int:
        n = 0
        while i & 1:
            i, n = i >> 1, n + 1
        return n

    rank = {gray(i): i for i in range(size)}
    following, digit = [], []
    for entry in range(size):
        for direction in range(dims):
            for label in range(size):
                w = rank[rotate(label ^ entry, -(direction + 1))]
                corner = gray(2 * ((w - 1) // 2)) if w else 0
                turn = 0 if w == 0 else trailing_ones(w - 1 if w % 2 == 0 else w) % dims
                e = entry ^ rotate(corner, direction + 1)
                d = (direction + turn + 1) % dims
                following.append(e * dims + d)
                digit.append(w)
    return following, digit


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Curve position of a cell, folding one bit plane at a time through the automaton."""
    following, digit = curve_tables(len(coords))
    n = len(coords)
    nxt = F.array(*[F.lit(x) for x in following])
    out = F.array(*[F.lit(x) for x in digit])

    def step(acc: Column, plane: Column) -> Column:
        label = F.lit(0)
        for k, c in enumerate(coords):
            label = label + F.getbit(c, plane).cast("int") * (1 << k)
        at = acc["state"] * (1 << n) + label
        return F.struct(
            F.element_at(nxt, at + 1).alias("state"),
            (acc["h"] * (1 << n) + F.element_at(out, at + 1)).cast("bigint").alias("h"),
        )

    planes = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("h"))
    return F.aggregate(planes, start, step, lambda acc: acc["h"])


def string_bounds(rows: DataFrame, names: list[str], total: int, cells: int) -> dict[str, list[str]]:
    """For each string column the highest value of each cell; a value's cell is that of the first of its rows in order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = None
    for k, c in enumerate(names):
        one = rows.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(k).alias("dim"), "value", "cnt")
        counted = one if counted is None else counted.unionByName(one)
    ranged = materialize(counted.repartitionByRange(n, "dim", "value").withColumn("range", F.spark_partition_id()), "values")
    # One row for each range and column.
    along = Window.partitionBy("dim").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("dim", "range").agg(F.sum("cnt").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(along), F.lit(0)))
    within = Window.partitionBy("dim", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.col("before") + F.sum("cnt").over(within) - F.col("cnt")
    placed = ranged.join(F.broadcast(sums.drop("own")), ["dim", "range"]).withColumn("begin", begin).withColumn("cell", F.expr(f"begin * {cells} div {max(total, 1)}"))
    found = placed.groupBy("dim", "cell").agg(F.max("value").alias("bound")).collect()
    release(ranged)
    return {c: sorted((r["bound"] for r in found if r["dim"] == k and r["bound"] is not None), key=lambda x: x.encode("utf-8")) for k, c in enumerate(names)}


def hilbert_shards(docs: DataFrame, num_shards: int = 16, bits: int = 4, max_groups: int = 65536, min_group: int = 512) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the curve index of every document; law: row counts at most one apart.

    ``max_groups`` bounds the table of sub-group counts (one task sums it); ``min_group`` is the least sub-group size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.col("lang").cast("string").alias("x1"),
            F.col("source").cast("string").alias("x2"),
            F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("place"),
        ),
        "hilbert",
    )
    cuts = [k / (1 << bits) for k in range(1, 1 << bits)]
    dims = ["size", "x1", "x2"]
    total, sizes = slim.agg(F.count(F.lit(1)), F.percentile_approx("size", cuts, 10000)).head()
    bounds = {"size": sorted(set(sizes or []))} | string_bounds(slim, ["x1", "x2"], total, 1 << bits)

    def quantised(c: str) -> Column:
        # The highest bound has nothing above it.
        return sum((F.coalesce(F.col(c) > b, F.lit(False)).cast("int") for b in bounds[c][: (1 << bits) - 1]), F.lit(0))

    curved = slim.withColumns({f"c{k}": quantised(c) for k, c in enumerate(dims)}).withColumn(
        "curve", hilbert_index([F.col(f"c{k}") for k in range(len(dims))], bits)
    )
    per_group = max(min_group, -(-total // max_groups))
    cells = curved.groupBy("curve").agg(F.ceil(F.count(F.lit(1)) / per_group).cast("bigint").alias("parts"))
    # At most 2**(bits * dims) rows: the number of cells, whatever the input.
    placed = curved.join(F.broadcast(cells), "curve").withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", "place"), F.col("parts")))
    counts = placed.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("cnt"))
    along = Window.orderBy("curve", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("curve", "part", F.coalesce(F.sum("cnt").over(along), F.lit(0)).alias("before"))
    # At most cells + max_groups rows.
    within = Window.partitionBy("curve", "part").orderBy("doc_id", "size", "text_crc32")
    ranked = placed.join(F.broadcast(offsets), ["curve", "part"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    shard = F.expr(f"(rank * {num_shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {num_shards - 1}) div {num_shards}")
    return ranked.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
