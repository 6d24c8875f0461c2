"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources in code-point order (null last) have the weights 3, 1, 2, repeating. Together they get ``share`` times all words;
a source's target stops at ``cap`` times its own words and the excess is shared again by weight. A source's words, laid out
in seeded document order, form equal blocks of about ``block_words`` words. Blocks go to sources by the highest quotients
target / (2k + 1), which makes integer quotas per source; the same rule splits a source's quota over its shards (hash cells
of at most about ``shard_words`` words, so no task orders a whole source). Within a shard the quota is spread evenly over the
blocks from a seeded start, hence no block, and no document, is taken more than ``cap`` times.

Defined cases: null text has no words and takes none; null doc_id and repeated rows are ordinary rows; an empty table, or one
without words, gives zero targets; extra columns are ignored; reruns give the same rows.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semdex.llm.common import materialize, words_of

WEIGHTS = (3, 1, 2)
#: Up to so many sources have their totals handled on the driver; more are planned by tables.
MAX_SOURCES = 200_000


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, none above cap times its size, the excess reshared by weight among the others."""
    target = [0.0] * len(sizes)
    left, open_ = total, sum(w for w, s in zip(weights, sizes) if s)
    order = sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: (cap * sizes[i] / weights[i], i))
    for i in order:
        target[i] = min(cap * sizes[i], left * weights[i] / open_)
        left -= target[i]
        open_ -= weights[i]
    return target


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2k + 1), ties to the earlier party.

    Starts at each party's rounded share and moves single seats, which ends at the same allocation as dealing all of them.
    """
    total = math.fsum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    got = [int(math.floor(v * seats / total + 0.5)) for v in votes]
    gap = seats - sum(got)
    if gap > 0:
        heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, got))]
        heapq.heapify(heap)
        for _ in range(gap):
            _, i = heapq.heappop(heap)
            got[i] += 1
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif gap < 0:
        heap = [(v / (2 * k - 1), -i) for i, (v, k) in enumerate(zip(votes, got)) if k]
        heapq.heapify(heap)
        for _ in range(-gap):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def plan_quotas(cells: list[tuple[int, int, int]], sizes: list[int], share: float, cap: float, block_words: int) -> tuple[list[float], list[tuple]]:
    """Targets by source, and (source, shard, blocks, quota) for each of the given (source, shard, words)."""
    weights = [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(sizes))]
    target = water_fill(sizes, weights, share * sum(sizes), cap)
    by_source: dict[int, list[tuple[int, int]]] = {}
    for s, shard, words in sorted(cells):
        by_source.setdefault(s, []).append((shard, -(-words // block_words)))
    votes = [t / size * sum(n for _, n in by_source[s]) if size else 0.0 for s, (t, size) in enumerate(zip(target, sizes))]
    quota = sainte_lague(votes, round(math.fsum(votes)))
    rows = []
    for s, own in by_source.items():
        for (shard, n), q in zip(own, sainte_lague([float(n) for _, n in own], quota[s])):
            rows.append((s, shard, max(n, 1), min(q, int(cap) * n)))
    return target, rows


def times_taken(block: str) -> str:
    """How often a block is taken: the step of C(j) = (j * quota + start) div blocks, which spreads the quota evenly."""
    return f"((({block}) + 1) * quota + start) div blocks - (({block}) * quota + start) div blocks"


def taken_upto(x: str) -> Column:
    """Words taken among the first x words of a shard: C(j) whole blocks before x's block j, and j's part before x."""
    j = f"({x} div width)"
    return F.expr(f"(({j} * quota + start) div blocks) * width + ({times_taken(j)}) * ({x} - {j} * width)").cast("bigint")


def weight_of(src: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (src % len(WEIGHTS)).cast("int") + 1)


def ranked_sources(slim: DataFrame) -> DataFrame:
    """name, words, rows and range of every source, and src, its rank by code point (null last); ranges are dealt by name."""
    n = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_name = F.col("name").asc_nulls_last()
    totals = slim.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    ranged = materialize(totals.repartitionByRange(n, by_name).withColumn("range", F.spark_partition_id()), "sources")
    before = offsets(ranged, F.lit(1))
    # One row per range.
    return ranged.join(F.broadcast(before), "range").withColumn("src", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(by_name)) - 1).drop("before")


def offsets(ranged: DataFrame, amount: Column) -> DataFrame:
    """For each range the total of amount in the ranges before it."""
    along = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.groupBy("range").agg(F.sum(amount).alias("own")).select("range", F.coalesce(F.sum("own").over(along), F.lit(0)).alias("before"))


def water_level(sources: DataFrame, share: float, cap: float) -> float:
    """Words a unit of weight gets when no target passes cap times its words; infinite if all targets stop there.

    Sources that a level fills are taken out and the rest is shared again, until a level fills no more of them.
    """
    total = share * int(sources.agg(F.sum("words")).head()[0])
    level, known = 0.0, -1
    while True:
        full = cap * F.col("words") <= level * F.col("weight")
        row = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("words"))), F.sum(F.when(~full, F.col("weight").cast("bigint")))).head()
        if row[2] is None:
            return math.inf
        if row[0] == known:
            return level
        known, level = row[0], (total - cap * (row[1] or 0)) / row[2]


def seats_above(votes: Column, least: Column) -> Column:
    """How many of a party's quotients votes / (2k + 1) reach least."""
    return F.floor((votes / least + 1) / 2)


def quota_bounds(sources: DataFrame, seats: int, grid: int = 15) -> tuple[float, float]:
    """Quotients (low, high), adjacent or with just the seats at low: at least the seats reach low, and fewer reach high.

    A round counts the seats at a geometric grid between the two, in one aggregate.
    """
    total, parties = sources.agg(F.sum("votes"), F.count(F.lit(1))).head()
    low, high = total / (2 * seats + parties + 1), total + 1
    while True:
        between = sorted({low * (high / low) ** (k / (grid + 1)) for k in range(1, grid + 1)} - {low, high})
        between = [t for t in between if low < t < high]
        if not between:
            return low, high
        counts = sources.agg(*[F.sum(seats_above(F.col("votes"), F.lit(t))) for t in between]).head()
        enough = [t for t, n in zip(between, counts) if n >= seats]
        fewer = [t for t, n in zip(between, counts) if n < seats]
        low, high = max(enough, default=low), min(fewer, default=high)
        if seats in counts:
            return low, high


def source_quotas(sources: DataFrame, seats: int) -> DataFrame:
    """sources (src, range, votes, ...) with quota: sainte_lague() for any number of sources."""
    if seats <= 0:
        return sources.withColumn("quota", F.lit(0).cast("bigint"))
    low, high = quota_bounds(sources, seats)
    sure, most = seats_above(F.col("votes"), F.lit(high)), seats_above(F.col("votes"), F.lit(low))
    counted = sources.withColumn("sure", sure).withColumn("tied", most - sure)
    left = seats - int(counted.agg(F.sum("sure")).head()[0])
    # Ties go to the earlier source: a running total within the range after that of the ranges before. One row per range.
    within = Window.partitionBy("range").orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    run = F.col("before") + F.sum("tied").over(within) - F.col("tied")
    extra = F.greatest(F.lit(0), F.least(F.col("tied"), F.lit(left) - run))
    return counted.join(F.broadcast(offsets(counted, F.col("tied"))), "range").withColumn("quota", (F.col("sure") + extra).cast("bigint")).drop("sure", "tied", "before")


PLAN = "src bigint, shard int, blocks bigint, quota bigint, target double"


def in_shards(slim: DataFrame, seed: int) -> DataFrame:
    """Rows with their seeded order and, of the source's shards, theirs."""
    return slim.withColumn("order", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("fp"))).withColumn("shard", F.pmod("order", "shards").cast("int"))


def lined_by_driver(slim: DataFrame, totals: list, shard_words: int, share: float, cap: float, block_words: int, seed: int) -> DataFrame:
    """Rows with their shard's plan, made on the driver from the totals of not too many sources."""
    spark = slim.sparkSession
    totals = sorted(totals, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    sizes = [int(r["words"]) for r in totals]
    sources = [(r["source"], i, max(1, -(-max(sizes[i], r["rows"]) // shard_words)), sizes[i]) for i, r in enumerate(totals)]
    # One row per source, at most MAX_SOURCES.
    known = F.broadcast(spark.createDataFrame(sources, "name string, src bigint, shards int, source_size bigint"))
    placed = in_shards(slim.join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source"), seed)
    cells = [(r["src"], r["shard"], int(r["words"])) for r in placed.groupBy("src", "shard").agg(F.sum("size").alias("words")).collect()]
    target, rows = plan_quotas(cells, sizes, share, cap, block_words)
    # One row per shard: at most max_shards and one per source.
    plan = F.broadcast(spark.createDataFrame([(*r, target[r[0]]) for r in rows], PLAN))
    return placed.join(plan, ["src", "shard"])


def lined_by_tables(slim: DataFrame, shard_words: int, share: float, cap: float, block_words: int, seed: int) -> DataFrame:
    """The same for any number of sources, whose targets and quotas are made by aggregates over a table of them.

    Only sources of more than one shard come to the driver and are broadcast: fewer than max_shards, with at most twice as
    many shards. Any other source has at most shard_words rows, so the join by source has no hot key.
    """
    spark = slim.sparkSession
    shards = F.greatest(F.lit(1), F.ceil(F.greatest("words", "rows") / shard_words)).cast("int")
    sources = materialize(ranked_sources(slim).withColumn("weight", weight_of(F.col("src"))).withColumn("shards", shards), "sources")
    hot = [(r["name"], r["src"], r["shards"], r["words"]) for r in sources.where("shards > 1").select("name", "src", "shards", "words").collect()]
    hot_sources = F.broadcast(spark.createDataFrame(hot, "name string, src bigint, shards int, source_size bigint"))
    same = F.col("source").eqNullSafe(F.col("name"))
    placed = in_shards(slim.join(hot_sources, same).drop("name", "source"), seed)
    own: dict[int, list[tuple[int, int]]] = {}
    for r in placed.groupBy("src", "shard").agg(F.sum("size").alias("words")).collect():
        own.setdefault(r["src"], []).append((r["shard"], -(-int(r["words"]) // block_words)))
    hot_blocks = F.broadcast(spark.createDataFrame([(s, sum(n for _, n in cells)) for s, cells in own.items()], "src bigint, hot_blocks bigint"))
    level = water_level(sources, share, cap)
    target = F.least(cap * F.col("words"), level * F.col("weight")) if level < math.inf else cap * F.col("words")
    blocks = F.coalesce("hot_blocks", F.expr(f"(words + {block_words - 1}) div {block_words}"))
    votes = F.coalesce(F.try_divide("target", F.col("words")) * F.col("blocks"), F.lit(0.0))
    voting = sources.join(hot_blocks, "src", "left").withColumn("target", target.cast("double")).withColumn("blocks", blocks).withColumn("votes", votes)
    voting = materialize(voting.drop("hot_blocks"), "votes")
    # A decimal sum does not depend on the order of its rows.
    seats = round(voting.agg(F.sum(F.col("votes").cast("decimal(38,10)"))).head()[0])
    quotas = materialize(source_quotas(voting, seats), "quotas")
    rows = []
    for r in quotas.where("shards > 1").select("src", "quota", "target").collect():
        cells = sorted(own[r["src"]])
        for (shard, n), q in zip(cells, sainte_lague([float(n) for _, n in cells], r["quota"])):
            rows.append((r["src"], shard, max(n, 1), min(q, int(cap) * n), r["target"]))
    lined = placed.join(F.broadcast(spark.createDataFrame(rows, PLAN)), ["src", "shard"])
    quota = F.least("quota", int(cap) * F.col("blocks")).alias("quota")
    cold_plan = quotas.where("shards = 1").select("name", "src", "shards", F.col("words").alias("source_size"), F.greatest("blocks", F.lit(1)).alias("blocks"), quota, "target")
    cold = in_shards(slim.join(hot_sources, same, "left_anti").join(cold_plan, same).drop("name", "source"), seed)
    return lined.unionByName(cold)


def mix(
    docs: DataFrame, share: float = 1.5, cap: float = 2.0, block_words: int = 128, min_shard_words: int = 100_000, max_shards: int = 65536, seed: int = 42, max_sources: int = MAX_SOURCES
) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, with its place in its shard and the shard's plan.

    A shard holds about max(min_shard_words, all words / max_shards) words, and about as many rows at most, so there are at
    most max_shards shards besides one for each source. Up to max_sources sources are planned on the driver, more by tables.
    """
    slim = materialize(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("bigint").alias("size"), F.xxhash64("text").alias("fp")), "mixing")
    by_source = slim.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    totals = by_source.limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        amount = by_source.agg(F.sum(F.greatest("words", "rows"))).head()[0]
    else:
        amount = sum(max(r["words"], r["rows"]) for r in totals)
    shard_words = max(min_shard_words, -(-amount // max_shards))
    options = (shard_words, share, cap, block_words, seed)
    lined = lined_by_tables(slim, *options) if len(totals) > max_sources else lined_by_driver(slim, totals, *options)
    run = Window.partitionBy("src", "shard").orderBy("order", "doc_id", "fp", "size").rowsBetween(Window.unboundedPreceding, 0)
    lined = lined.withColumn("width", F.lit(block_words).cast("bigint")).withColumn("end", F.sum("size").over(run)).withColumn("begin", F.col("end") - F.col("size"))
    lined = lined.withColumn("start", F.pmod(F.xxhash64(F.lit(seed), F.col("src"), F.col("shard")), F.col("blocks")))
    return lined.withColumn("taken", (taken_upto("end") - taken_upto("begin")).cast("bigint")).select(
        "doc_id", "size", "source_size", "target", "taken", "fp", "begin", "width", "quota", "blocks", "start"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs with the text reduced to its taken words, a row for each time they are taken.

    Documents none of whose words are taken are absent, as the mix holds nothing of them. Rows are matched to their place
    by doc_id and text hash; repeated rows (equal in both) get the places of their group one each.
    """
    cap = int(options.get("cap", 2.0))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    plan = F.struct("taken", "size", "begin", "width", "quota", "blocks", "start")
    spans = mix(docs, **options).select(key.alias("k1"), F.col("fp").alias("k2"), plan.alias("p"))
    again = Window.partitionBy("k1", "k2").orderBy("p.begin", "p.start", "p.blocks", "p.quota")
    spans = spans.withColumn("k3", F.row_number().over(again)).where("p.taken > 0").hint("shuffle_hash")
    rows = docs.select(F.struct(*docs.columns).alias("d"), key.alias("e1"), F.xxhash64("text").alias("e2"), F.col("source").alias("e4"))
    rows = rows.withColumn("e3", F.row_number().over(Window.partitionBy("e1", "e2").orderBy("e4")))
    # Both sides lie by (id, text hash) already; as two bounds the number is no join key, so texts are not dealt anew for it.
    joined = rows.join(spans, (F.col("e1") == F.col("k1")) & (F.col("e2") == F.col("k2")) & (F.col("e3") <= F.col("k3")) & (F.col("e3") >= F.col("k3")))
    piece = r"[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"
    times = times_taken("(p.begin + k) div p.width").replace("quota", "p.quota").replace("start", "p.start").replace("blocks", "p.blocks")
    texts = F.expr(
        f"CASE WHEN p.taken = p.size * {cap} OR p.quota = p.blocks THEN transform(sequence(1, {cap}), c -> IF(c * p.size <= p.taken, d.text, '')) "
        f"ELSE get(transform(array(regexp_extract_all(d.text, '{piece}', 0)), ps -> "
        f"transform(sequence(1, {cap}), c -> concat_ws('', filter(ps, (w, k) -> ({times}) >= c)))), 0) END"
    )
    copies = joined.select("d", F.explode(F.filter(texts, lambda t: t != "")).alias("kept"))
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("bigint")}
    return copies.select(*[changed.get(c, F.col("d")[c]).alias(c) for c in docs.columns])


def op9(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
