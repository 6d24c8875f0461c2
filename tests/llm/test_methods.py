"""The operators against brute-force versions, exact round trips and held-out accuracy."""

import hashlib
import itertools
import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semdex.llm import crf_toxicity as crf
from semdex.llm import hilbert_sharding, induced_sort, mixing, mtree, packing, pu_quality, simhash, suffix_dedup, wordpiece
from semdex.llm import queries as registered


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


# --- Quality --------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pu_quality.op1(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id)
    again = pu_quality.op1(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert sorted(again.score.round(9)) == sorted(got.score.round(9))


def test_held_out_labels_do_not_matter(spark, docs, labels):
    held = pu_quality.remainder(F.col("doc_id"), 4) == 2
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda lab: sorted(r["score"] for r in pu_quality.op1(docs, lab).collect())
    assert np.allclose(scores(labels), scores(flipped), atol=1e-9)


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_estimate(prior):
    rng = np.random.default_rng(0)
    pos = rng.normal(2, 1, 4000)
    unl = np.where(rng.random(6000) < prior, rng.normal(2, 1, 6000), rng.normal(-2, 1, 6000))
    assert abs(pu_quality.estimate_prior(pos, unl) - prior) < 0.08


def test_non_negative_risk_separates():
    rng = np.random.default_rng(1)
    p = rng.normal(1.5, 1, (500, 2))
    u = np.concatenate([rng.normal(1.5, 1, (300, 2)), rng.normal(-1.5, 1, (700, 2))])
    model = pu_quality.fit(np.pad(p, ((0, 0), (0, 3))), np.pad(u, ((0, 0), (0, 3))))
    s = model.score(np.pad(u, ((0, 0), (0, 3))))
    assert (s[:300] > 0.5).mean() > 0.9 and (s[300:] < 0.5).mean() > 0.9


# --- Suffix sorting -------------------------------------------------------------------------------------------------


def joined(strings):
    return np.concatenate([np.append(np.frombuffer(s, np.uint8), 0).astype(np.uint8) for s in strings])


@settings(max_examples=150, deadline=None)
@given(
    strings=st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=25).map(bytes), min_size=1, max_size=4),
    depth=st.sampled_from([3, 12, 1000]),
    limit=st.sampled_from([2, 1000]),
    base=st.sampled_from([2, 1000]),
)
def test_induced_order_and_common_prefixes(tmp_path_factory, strings, depth, limit, base):
    t = joined(strings + strings[:1])
    out = list(induced_sort.suffix_order(t, 8, depth, str(tmp_path_factory.mktemp("q")), limit, base))
    pos, lcp = (np.concatenate([x[k] for x in out]).tolist() for k in range(2))
    raw = t.tobytes()
    assert sorted(pos) == list(range(len(t)))
    for a, b, n in zip(pos, pos[1:], lcp[1:]):
        x, y = raw[a:], raw[b:]
        want = next((k for k in range(min(len(x), len(y), depth)) if x[k] != y[k]), min(len(x), len(y), depth))
        assert n == want and (n == depth or x < y)


@pytest.mark.parametrize("falling", [False, True])
def test_queue_goes_to_disk(tmp_path, falling):
    q = induced_sort.BucketQueue(induced_sort.Scratch(str(tmp_path)), 10, induced_sort.tuple_type(200, 5), falling)
    for k in range(40):
        q.push(k % 3, np.array([k, k + 100]), np.array([0, 1]))
    assert q.spilled > 0 and q.total <= 10
    for s in sorted(range(3), reverse=falling):
        q.push(s, np.array([7 + s]), np.array([0]))
        got = []
        while (run := q.pop(s)) is not None:
            got += run[0].tolist()
        assert got == [x for k in range(40) if k % 3 == s for x in (k, k + 100)] + [7 + s]
    assert not list(tmp_path.iterdir())


def test_memory_does_not_follow_the_text(tmp_path, monkeypatch):
    """Queues spill, substrings go to files and the names recurse; four times the text takes less than twice the memory."""
    import tracemalloc

    monkeypatch.setattr(induced_sort, "CHUNK", 1 << 12)
    rng = np.random.default_rng(1)
    base = rng.integers(97, 101, 20_000).astype(np.uint8)
    most = []
    for n in (1700, 6800):
        text = np.concatenate([np.append(base[a : a + 150], 0).astype(np.uint8) for a in rng.integers(0, len(base) - 150, n)])
        text.tofile(tmp_path / str(n))
        symbols = np.asarray(np.memmap(tmp_path / str(n), np.uint8, "r"))
        counted, spilled, gone = np.asarray(np.memmap(tmp_path / "counted", np.uint8, "w+", shape=text.shape)), [], np.zeros(len(text), bool)
        counted[:] = (np.arange(len(text)) % 151) <= 50
        tracemalloc.start()
        for found in induced_sort.repeated(symbols, 100, counted, 1 << 9, 1 << 13, str(tmp_path), spilled.append):
            gone[found] = True
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert min(spilled[-2:]) > 0
        seen, want = set(), np.zeros(len(text), bool)
        raw = text.tobytes()
        for p in np.flatnonzero(counted).tolist():
            w = raw[p : p + 100]
            want[p] = w in seen
            seen.add(w)
        assert (gone == want).all()
    # Words, order, names and tuples in memory would be some 40 bytes a symbol.
    assert most[1] < 2 * most[0] and most[1] < 8 * len(text)


def removed_by_brute_force(rows, length):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[doc_id] = (len(raw), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(rest).hexdigest())
    return out


def result(df):
    return {r["d"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_repeats_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(suffix_dedup.deduplicated(docs)) == removed_by_brute_force(rows, 100)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_crafted_texts(spark, seed, monkeypatch):
    """Short strings of few letters: ties of anchors, self-overlaps, runs; segments, groups, batches and shards all tiny."""
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("ab "), rng.integers(0, 120))) for _ in range(25)]
    texts += [t[: len(t) // 2] + "ab" * 30 for t in texts[:10]] + ["a" * 90, "a" * 40, texts[3], texts[3] + "x", "é" * 30]
    rows = list(enumerate(texts))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 37)
    monkeypatch.setattr(suffix_dedup, "GROUP", 150)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = result(suffix_dedup.deduplicated(df, length=20, gram=7, shard=60))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == removed_by_brute_force(rows, 20)


def test_hot_passages_settle_in_every_step(spark):
    line, passage = "the one line that everybody quotes, fifty-two bytes.", "p" + "assage of well over one hundred bytes that is shared by all of the documents in this table, whole " * 2
    rng = np.random.default_rng(5)
    filler = lambda: "".join(rng.choice(list("abcdefghijklmnop "), 150))
    rows = [(k, filler() + line + filler() + (passage if k % 2 else "") + filler()) for k in range(120)] + [(k, line * 5) for k in range(120, 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(suffix_dedup.deduplicated(df)) == removed_by_brute_force(rows, 100)


def test_repeated_rows_are_one_document(spark):
    """Rows of equal id and text, or of no id and equal text, among texts that share their middle with different surroundings."""
    rng = np.random.default_rng(11)
    filler = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n))
    middle = filler(80)
    texts = [filler(150) + middle + filler(150) for _ in range(20)]
    texts += [t[100:260] + filler(60) for t in texts[:6]]
    order = sorted(texts, key=lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(t.encode(), 42) >> 63 else 0))
    want = sorted(removed_by_brute_force(list(enumerate(order)), 100).values())
    for name in (None, 7):  # all texts under no id, or under one
        df = spark.createDataFrame([(name, t) for t in texts + texts[:15] * 2], "doc_id long, text string").repartition(3)
        got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.op2(df).collect()]
        assert len(got) == len(texts) + 30 and sorted(set(got)) == want


def test_a_passage_in_distinct_surroundings_is_dealt_out(spark, monkeypatch):
    """Passages of 70 and 130 bytes in a great many documents, never with equal text before or after them."""
    rng = np.random.default_rng(12)
    filler = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    short, long_ = filler(70), filler(130)
    rows = [(k, filler(60) + (short, long_)[k % 2] + filler(60)) for k in range(600)]
    rows += [(k + 600, t[20:190]) for k, (_, t) in enumerate(rows[:40])]  # windows over the edges that do repeat
    shard, real = 2000, suffix_dedup.sorted_of

    def watched(*options):
        work = real(*options)

        def emit(batches):
            held = Counter()

            def passed():
                for batch in batches:
                    for h, raw in zip(batch.column("h").to_pylist(), batch.column("bytes").to_pylist()):
                        held[h] += len(raw)
                    yield batch

            yield from work(passed())
            assert not held or max(held.values()) <= 2 * shard

        return emit

    monkeypatch.setattr(suffix_dedup, "sorted_of", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(suffix_dedup.deduplicated(df, shard=shard)) == removed_by_brute_force(rows, 100)


def test_cleaned_documents(spark, docs):
    out = suffix_dedup.cleaned_documents(docs)
    assert out.columns == docs.columns
    done = {r["d"]: r for r in suffix_dedup.deduplicated(docs).collect()}
    got = {r["doc_id"]: r for r in out.collect()}
    # Gone are the documents with nothing left, or nothing but parts of cut characters.
    assert set(got) <= set(done) and all(r["n_removed"] > 0 and r["n_bytes"] - r["n_removed"] < 4 for i, r in done.items() if i not in got)
    assert all(i in got for i, r in done.items() if r["n_removed"] == 0 or r["n_bytes"] - r["n_removed"] >= 4)
    for i, r in got.items():
        assert r["n_chars"] == len(r["text"])
        if done[i]["n_removed"] == 0:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == done[i]["kept_sha256"]


# --- Sharding ---------------------------------------------------------------------------------------------------------


def test_hilbert_curve_visits_neighbours(spark):
    coords = spark.range(512).select(*[F.expr(f"cast((id div {8**k}) % 8 as int)").alias(c) for k, c in enumerate("abc")])
    cells = coords.withColumn("h", hilbert_sharding.hilbert_index([F.col(c) for c in "abc"], 3)).orderBy("h").toPandas()
    assert cells.h.tolist() == list(range(512))
    assert (cells[list("abc")].diff().abs().sum(axis=1)[1:] == 1).all()


@pytest.mark.parametrize("shards,per_group", [(16, 512), (7, 3), (500, 1)])
def test_shards_differ_by_one_row(docs, shards, per_group):
    out = hilbert_sharding.hilbert_shards(docs, shards, min_group=per_group).toPandas()
    sizes = Counter(out["shard"])
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1 and set(sizes) <= set(range(shards))
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    curve = out.groupby("shard").curve.agg(["min", "max"])
    assert (curve["max"].to_numpy()[:-1] <= curve["min"].to_numpy()[1:]).all()
    text = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert all((s, c) == (len(text[i]) + 1, zlib.crc32(text[i])) for i, s, c in zip(out.doc_id, out["size"], out.text_crc32))


def test_sources_of_one_prefix_have_cells_of_their_own(spark):
    """Whole strings are ranked: sources that differ after many bytes lie in different cells, and in few shards each."""
    rows = [(k, "same size", "en", f"https://site{k % 16:02}.org") for k in range(1600)] + [(None, "same size", None, None)] * 40
    out = hilbert_sharding.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), min_group=16).collect()
    source = {k: s for k, _, _, s in rows}
    where = defaultdict(set)
    for r in out:
        where[source[r["doc_id"]]].add(r["shard"])
    assert len({r["curve"] for r in out}) >= 15 and max(map(len, where.values())) <= 3
    count = Counter(r["shard"] for r in out)
    assert max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in count.items())


def test_shards_equal_a_plain_walk_along_the_curve(spark, docs):
    """Shard and slot by sorting all rows along the curve on one machine, with the operator's cells and groups."""
    out = hilbert_sharding.hilbert_shards(docs, num_shards=7).toPandas()
    n = len(out)
    walk = out.sort_values(["shard", "slot"]).reset_index(drop=True)
    assert (walk.curve.diff().dropna() >= 0).all()
    assert (walk.shard == [k * 7 // n for k in range(n)]).all()


def test_sharding_stays_out_of_python(docs):
    plan = hilbert_sharding.hilbert_shards(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- Toxicity -----------------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.floats(-4, 4), min_size=1, max_size=7), min_size=1, max_size=6), st.integers(0, 99))
def test_marginals_equal_enumeration(sequences, seed):
    rng = np.random.default_rng(seed)
    trans, start = rng.normal(size=(2, 2)), float(rng.normal())
    emit = np.concatenate([np.array(s) for s in sequences])
    first = np.concatenate([np.append(True, np.zeros(len(s) - 1, bool)) for s in sequences])
    got, _, _ = crf.marginals(emit, first, start, trans)
    want = []
    for s in sequences:
        total, on = 0.0, np.zeros(len(s))
        for code in range(2 ** len(s)):
            tags = [code >> k & 1 for k in range(len(s))]
            weight = np.exp(sum(e for e, t in zip(s, tags) if t) + start * tags[0] + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
            total += weight
            on += weight * np.array(tags)
        want += (on / total).tolist()
    assert np.allclose(got, want)


def test_toxicity_on_held_out_labels(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = crf.op4(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)
    assert (got.predicted == got.toxic).mean() > 0.95 and got.predicted[got.toxic == 1].mean() > 0.6


def test_scores_equal_enumeration(spark):
    """Score and spans of documents from sums over all taggings of each."""
    model = crf.Field({"bad": 4.0, "^bad": 1.5, "good": -2.0}, -2.5, -0.3, np.array([[0.2, -0.4], [-0.1, 0.9]]), np.array([-3.0, 2.0, 1.0, 0.7]), True)
    texts = ["a bad, baddest good bad", "good", "", None, "bad bad\tx  bad", "none of it is here"]
    got = crf.tagged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for text, row in zip(texts, got):
        words = (text or "").split()
        weight, mass = 0.0, np.zeros(len(words))
        for tags in itertools.product((0, 1), repeat=len(words)):
            x = sum(model.emission(w) for w, y in zip(words, tags) if y) + (model.start if tags and tags[0] else 0.0)
            x += sum(model.trans[a, b] for a, b in zip(tags, tags[1:]))
            weight += np.exp(x)
            mass += np.exp(x) * np.array(tags)
        p = mass / weight
        x = [1, np.log1p(p.sum()), p.max(initial=0), np.log1p(min(10, 100 * p.sum() / max(1, len(words))))]
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-np.dot(x, model.scale))), abs=1e-9)
        inside = [any(s["begin"] <= m.start() < s["end"] for s in row["spans"]) for m in re.finditer(r"\S+", text or "")]
        assert inside == (p >= 0.5).tolist()


def test_the_fitting_sample_is_bounded_and_repeats_do_not_push_ids_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(crf, "fit", lambda rows, most: seen.extend(rows))
    rows = [(k, f"text {k} {c}") for k in range(40) for c in "ba"] + [(40, "x" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    crf.fit_on(docs, spark.createDataFrame([(k, 1, k % 2) for k in range(41)], "doc_id long, quality int, toxic int"), 100, 100, max_bytes=100)
    learnt = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    assert sorted(seen) == sorted((f"text {k} a", k % 2) for k in learnt)


def test_spans_are_offsets(spark, docs, labels):
    model = crf.fit_on(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    text = "A calm start, you stupid idiot! And a calm end."
    (a, b, p), = crf.spans(text, model)
    assert text[a:b] == "stupid idiot!" and p > 0.5
    assert crf.spans("", model) == [] and crf.spans(None, model) == []
    rows = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert [len(r["spans"]) for r in crf.tagged(rows, model).orderBy("doc_id").collect()] == [1, 0]


# --- SimHash ------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs):
    texts = [r["text"] for r in docs.limit(60).collect()] + ["", None, "One", "one TWO", "É é x", "a " * 700]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def linked(fps, most=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = sorted(fps)
    for k, a in enumerate(own):
        for b in own[k + 1 :]:
            if (a ^ b).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(set)
    for f in fps:
        groups[find(f)].add(f)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_all_pairs(spark, seed):
    """Chains at distances 1 to 5, across both halves, and a dense cluster."""
    rng = np.random.default_rng(seed)
    bits = lambda n: sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        f = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(6):
            fps.add(f)
            f ^= bits(int(rng.integers(1, 6)))
    fps |= {12345 ^ bits(2) for _ in range(40)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    out = simhash.near_components(spark.createDataFrame(signed, "fp long")).collect()
    got = defaultdict(set)
    for r in out:
        got[r["root"]].add(r["fp"] % (1 << 64))
    assert {frozenset(g) for g in got.values()} == linked(fps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 2)), max_size=40), st.integers(1, 7), st.integers(1, 50))
def test_keys_of_one_component_are_dropped(rows, step, most):
    import pyarrow as pa

    rows = sorted((k, r) for k, r in rows)
    batches = [
        pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array(range(a, a + len(part)), pa.int64()), pa.array([x[1] for x in part], pa.int64())], names=["key", "fp", "root"])
        for a in range(0, len(rows), step)
        for part in [rows[a : a + step]]
    ]
    got = [f for b in simhash.mixed_of(most)(iter(batches)) for f in b.column(1).to_pylist()]
    roots = defaultdict(set)
    for k, r in rows:
        roots[k].add(r)
    size = Counter(k for k, _ in rows)
    want = [f for f, (k, _) in enumerate(rows) if len(roots[k]) > 1]
    assert set(want) <= set(got) and len(set(got)) == len(got)
    assert all(len(roots[rows[f][0]]) > 1 or size[rows[f][0]] > most for f in got)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_at_distance_three_meet(seed):
    """Whatever three bits differ, some block left out leaves keys that share a variant."""
    rng = np.random.default_rng(seed)
    masks = [(kept & (1 << 64) - 1, m & (1 << 64) - 1) for kept, m in simhash.PARTIAL_BALLS]
    for _ in range(100):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for k in rng.choice(64, 3, replace=False).tolist():
            b ^= 1 << k
        assert {a & kept ^ m for kept, m in masks} & {b & kept ^ m for kept, m in masks}


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000 + k, 1000) for k in range(1, 50)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(50)}


def test_unfinished_components_are_an_error(spark):
    chain = spark.createDataFrame([(k + 1, k) for k in range(30)], "a long, b long")
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        simhash.components(chain, max_rounds=2)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_representative_of_each_component(spark, kind):
    """Null and repeated ids: of each component one row, and no component without one."""
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(6)]
    assert all((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3 for a in texts for b in texts if a != b)
    name = (lambda i: i) if kind == "long" else (lambda i: None if i is None else str(i))
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1].upper()), (None, texts[2]), (3, texts[2])]  # ids null, or not all
    rows += [(7, texts[3]), (7, texts[4]), (7, texts[4]), (8, texts[4]), (9, texts[5]), (9, texts[5].upper())]  # ids repeated
    df = spark.createDataFrame([(name(i), t, k) for k, (i, t) in enumerate(rows)], f"doc_id {kind}, text string, n int").repartition(3)
    got = sorted((r["text"].lower(), r["doc_id"]) for r in simhash.representatives(df).collect())
    assert got == [(t, name(i)) for t, i in zip(texts, [None, None, 3, 7, 7, 9])]


def test_component_is_least_doc(spark):
    rows = [(9, "a b c d"), (4, "A b  c d"), (7, ""), (3, None), (5, "other words entirely here")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.op6(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {9: 4, 4: 4, 7: 3, 3: 3, 5: 5}


# --- Word pieces --------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4)), st.sets(st.text("abc", min_size=1, max_size=4)), st.lists(st.text("abcd", min_size=1, max_size=12), max_size=8))
def test_automaton_counts_as_greedy(initial, continuing, words):
    enc = lambda s: {x.encode() for x in s}
    automaton = wordpiece.LongestMatch(enc(initial), enc(continuing))

    def greedy(word):
        n, k = 0, 0
        while k < len(word):
            own = continuing if k else initial
            end = next((e for e in range(len(word), k, -1) if word[k:e] in own), None)
            if end is None:
                return -1
            n, k = n + 1, end
        return n

    assert [automaton.count(w.encode()) for w in words] == [greedy(w) for w in words]


def test_token_counts(spark, docs):
    out = wordpiece.op7(docs).toPandas()
    words = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    assert (out.n_tokens >= out.n_words).all() and all(words[i] == n for i, n in zip(out.doc_id, out.n_words)) and (out.n_unknown == 0).all()
    cache = wordpiece.Counts(wordpiece.from_ranks(wordpiece.default_path()), limit=3)
    assert [cache[w] for w in (b"a", b"b", b"c", b"d", b"a")] == [1] * 5 and len(cache) <= 3


# --- Packing ------------------------------------------------------------------------------------------------------------


def test_piece_lengths():
    assert packing.piece_lengths(1) == [1] and packing.piece_lengths(2048) == [2048]
    assert packing.piece_lengths(5000) == [2048, 2048, 512, 256, 128, 8]
    for n in range(1, 300):
        assert sum(packing.piece_lengths(n, 16)) == n and all(x & (x - 1) == 0 for x in packing.piece_lengths(n, 16))


def test_fast_ids_equal_the_library(docs):
    json_path, ranks = packing.default_paths()
    odd = ["", "x<|endoftext|>y", "<| a", "a\x1fb c", "don't I'LL we're", "  two  spaces\n\n\tx ", "日本語 12½ ²", "é" * 50, "naïve Straße"]
    for text in [r["text"] for r in docs.collect()] + odd:
        assert packing.token_ids(text, json_path, ranks) == packing.token_ids(text, json_path)


def test_packed_pieces_round_trip(spark, docs):
    paths = packing.default_paths()
    out = packing.packed(docs, *paths).toPandas()
    assert out.sequence_id.is_unique and (out.offset == 0).all() and (2**out.bucket == out.length).all()
    for r in docs.limit(50).collect():
        own = out[out.doc_id == r["doc_id"]].sort_values("start")
        ids = packing.token_ids(r["text"], *paths) + [1]
        assert np.concatenate(own.ids.tolist()).tolist() == ids and set(own.doc_tokens) == {len(ids)}
        assert own.start.tolist() == np.append(0, np.cumsum(own.length))[:-1].tolist()
        assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(own.ids, own.ids_crc32))


# --- Mixing -------------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9), st.integers(0, 400))
def test_sainte_lague_deals_by_highest_quotients(votes, seats):
    got = mixing.sainte_lague([float(v) for v in votes], seats)
    want = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
        want[best] += 1
    assert got == want


def reshared(sizes, weights, total, cap):
    """The rule as told: share by weight, stop at the cap, reshare the excess, until none is above."""
    fixed = {}
    while True:
        open_ = [i for i in range(len(sizes)) if i not in fixed and sizes[i]]
        left = total - sum(fixed.values())
        share = {i: left * weights[i] / sum(weights[k] for k in open_) for i in open_}
        over = [i for i in open_ if share[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=9))
def test_targets_stop_at_the_cap(sizes):
    weights = [float(mixing.WEIGHTS[i % 3]) for i in range(len(sizes))]
    got = mixing.water_fill(sizes, weights, 1.5 * sum(sizes), 2.0)
    assert np.allclose(got, reshared(sizes, weights, 1.5 * sum(sizes), 2.0))


@pytest.mark.parametrize("shard_words", [100_000, 3000])
def test_mix(docs, shard_words):
    out = mixing.mix(docs, min_shard_words=shard_words)
    rows = out.toPandas().merge(docs.select("doc_id", "source", "text").toPandas(), on="doc_id")
    assert (rows["size"] == rows.text.map(lambda t: len(t.split()))).all()
    assert (rows.taken <= 2 * rows["size"]).all() and (rows.taken >= 0).all()
    for _, own in rows.groupby("source"):
        assert own["size"].sum() == own.source_size.iloc[0]
        shards = max(1, own["size"].sum() // shard_words + 1)
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 200 * shards
    again = mixing.mix(docs.repartition(5), min_shard_words=shard_words).toPandas()
    key = ["doc_id", "taken"]
    assert rows[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_any_number_of_sources(spark):
    """Planned by tables, the mix is the one planned on the driver; sources rank by code point, null last."""
    rng = np.random.default_rng(11)
    names = [*(f"s{k}" for k in range(150)), "é", "zz", "\U0001f600", "\ufb01", "", None]
    rows = [(k, names[int(rng.integers(len(names)))], "w " * int(rng.integers(0, 700))) for k in range(1500)]
    rows += [(2000 + k, "s7", "x " * 900) for k in range(150)] + [(3000 + k, "s8", None) for k in range(700)] + [(4000, "only empty", ""), (None, None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    options = {"min_shard_words": 500 * 20, "block_words": 16}
    want = mixing.mix(docs, **options).toPandas().sort_values(["doc_id", "size"]).reset_index(drop=True)
    got = mixing.mix(docs, max_sources=3, **options).toPandas().sort_values(["doc_id", "size"]).reset_index(drop=True)
    exact = ["doc_id", "size", "source_size", "taken", "quota", "blocks", "start", "begin"]
    assert got[exact].equals(want[exact])
    assert np.allclose(got.target, want.target)
    assert want[want.doc_id == 2000].source_size.iloc[0] > 2 * options["min_shard_words"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.3, 1.0, 1.0, 2.5, 7.0, 40.0]), min_size=1, max_size=9), st.integers(0, 90))
def test_quotas_by_tables(spark, votes, seats):
    table = spark.createDataFrame([(k, k // 3, v) for k, v in enumerate(votes)], "src long, range int, votes double")
    seats = seats if sum(votes) else 0
    got = {r["src"]: r["quota"] for r in mixing.source_quotas(table, seats).collect()}
    assert [got[k] for k in range(len(votes))] == mixing.sainte_lague(votes, seats)


def test_mixed_documents_hold_the_taken_words(spark, docs):
    twice = docs.unionByName(docs.where("doc_id < 20"))
    taken = {r["doc_id"]: r["t"] for r in mixing.mix(twice).groupBy("doc_id").agg(F.sum("taken").alias("t")).collect()}
    out = mixing.mixed_documents(twice)
    assert out.columns == docs.columns
    got = Counter()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
        words = iter(text[r["doc_id"]].split())
        assert all(w in words for w in r["text"].split())  # in order
    assert dict(got) == {i: t for i, t in taken.items() if t}


# --- Top-k --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "integers"])
def test_tree_equals_brute_force(kind):
    rng = np.random.default_rng(3)
    n, dims = 700, 8
    v = {
        "random": lambda: rng.integers(-1000, 1000, (n, dims)),
        "clustered": lambda: np.repeat(rng.integers(-1000, 1000, (20, dims)), 35, axis=0) + rng.integers(-3, 3, (n, dims)),
        "equal": lambda: np.ones((n, dims), np.int64),
        "integers": lambda: rng.integers(0, 2, (n, dims)),
    }[kind]().astype(np.int64)
    ids = rng.permutation(n)
    tree = mtree.MTree(ids, v, page=16, fanout=4)
    for k in range(0, n, 37):
        scores = v @ v[k]
        want = sorted(((int(s), int(i)) for s, i in zip(scores, ids) if i != ids[k]), key=lambda x: (-x[0], x[1]))[:10]
        assert tree.search(v[k], 10, int(ids[k])) == want
    if kind == "clustered":
        assert tree.computed < 0.6 * n * len(range(0, n, 37))


def test_top_k_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-50, 50, (300, 5))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, v array<long>")
    got = defaultdict(list)
    for r in mtree.top_k(rows, rows.where("vec_id % 10 = 0"), 4, block_rows=40).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    for q in range(0, 300, 10):
        assert got[q] == sorted(((int(v[k] @ v[q]), k) for k in range(300) if k != q), key=lambda x: (-x[0], x[1]))[:4]


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_trees_are_built_once_and_queries_go_where_they_must(spark, tmp_path, monkeypatch, kind):
    """Each row is in one tree; of clustered vectors, trees and routes shuffle fewer than three times the table's rows."""
    rng = np.random.default_rng(5)
    n, dims = 12000, 8
    centres = rng.integers(-400, 400, (60, dims))
    v = rng.integers(-400, 400, (n, dims)) if kind == "random" else centres[rng.integers(0, 60, n)] + rng.integers(-4, 5, (n, dims))
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, v array<long>").write.parquet(str(tmp_path / "v"))
    rows = spark.read.parquet(str(tmp_path / "v"))
    kept, real = {}, {"materialize": mtree.materialize, "routed_by": mtree.routed_by}
    monkeypatch.setattr(mtree, "materialize", lambda df, name: kept.setdefault("built", real["materialize"](df, name)))
    monkeypatch.setattr(mtree, "routed_by", lambda level, radii: kept.setdefault("routes", real["routed_by"](level, radii)))
    found = defaultdict(list)
    for r in mtree.top_k(rows, rows.where("vec_id % 10 = 0"), 5).collect():
        found[r["query_id"]].append((-r["score"], r["vec_id"]))
    for q in range(0, n, 490):
        assert sorted(found[q]) == sorted(((-int(s), k) for k, s in enumerate(v @ v[q]) if k != q))[:5]
    trees = [pickle.loads(r["body"]) for r in kept["built"].where("body IS NOT NULL").select("body").collect()]
    assert sorted(i for t in trees for i in t.ids.tolist()) == list(range(n)) and len(trees) <= 2 * mtree.FEW_PIVOTS
    asked = kept["built"].where("query_id IS NOT NULL").select("query_id", "v", "least", F.col("tree").alias("home"))
    sent = asked.mapInArrow(kept["routes"], "query_id long, v array<long>, least long, home long, page int, d double, reach double").count()
    assert asked.count() == n // 10 and (kind == "random" or n + sent < 3 * n)


def test_large_components_are_exact_or_an_error(spark):
    def run(*vectors):
        rows = spark.createDataFrame([(100 * k, [float(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        return {(r["query_id"], r["vec_id"]): r["score"] for r in mtree.op10(rows).collect()}

    big = 2.0**20  # times 1024 is 2**30, whose square is 2**60
    assert run([big, 1.0], [big, -2.0], [-big, 3.0])[0, 100] == 2**60 - 2 * 1024**2
    assert run([2e6] * 2, [2e6] * 2)[0, 100] == 2 * 2_048_000_000**2
    for vectors in ([[3e6] * 64] * 2, [[1e300, 1.0], [1.0, 1.0]]):
        with pytest.raises(Exception, match="beyond"):
            run(*vectors)


# --- Registration -------------------------------------------------------------------------------------------------------


def test_a_query_for_each_operator():
    names = registered.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))


@pytest.mark.parametrize("name", list(registered.oracle_sql()))
def test_equals_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    shown = lambda df: df[sorted(df.columns)].astype(str).sort_values(sorted(df.columns)).reset_index(drop=True)
    assert shown(registered.queries()[name](spark, sf).toPandas()).equals(shown(c.sql(registered.oracle_sql()[name]).df()))
