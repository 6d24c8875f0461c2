"""Every operator and stage on awkward small tables: nulls, empty and long texts, ties, repeated rows, no rows, extra columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from semdex.llm import crf_toxicity, hilbert_sharding, mixing, mtree, packing, pu_quality, quality_rules, simhash, suffix_dedup, wordpiece

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "many plain words and then some more of them " * 3000
ROWS = [
    (1, "the first of the plain texts is here and it has some words", "en", "a", 10),
    (1, "the first of the plain texts is here and it has some words", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \n\t", "en", "b", 3),
    (5, LONG, "en", "a", len(LONG)),
    (None, "a text without a number, but with words", "de", "c", 5),
    (6, "one", "fr", None, 3),
    (7, "é😀 <|endoftext|> ça\x1f x ñ\r\n", "fr", "b", 9),
    (8, "word\n" * 50, "en", "a", 250),
]
LABELS = "doc_id long, quality int, toxic int"

OPERATORS = {
    "op2": suffix_dedup.op2,
    "op3": hilbert_sharding.hilbert_shards,
    "op5": quality_rules.op5,
    "op6": simhash.op6,
    "op7": wordpiece.op7,
    "op8": packing.op8,
    "op9": mixing.op9,
}
LABELLED = {"op1": pu_quality.op1, "op4": crf_toxicity.op4}


@pytest.fixture(scope="module")
def docs(spark):
    """With columns that operators use as names of their own."""
    extra = {c: F.lit("x") for c in ("shard", "slot", "size", "taken", "fp", "d", "th", "h", "words", "lines", "rank", "curve", "row", "kept", "score", "begin", "bucket", "length", "key", "order")}
    return spark.createDataFrame(ROWS, DOCS).withColumns(extra)


def labels(spark, rows):
    return spark.createDataFrame(rows, LABELS)


SOME_LABELS = [(k, k % 2, (k + 1) % 2) for k in range(1, 9)] + [(None, 1, 1), (3, None, None)]


def count_by_id(df):
    return {r["doc_id"]: r["count"] for r in df.groupBy("doc_id").count().collect()}


EACH = {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, None: 1, 6: 1, 7: 1, 8: 1}


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "op8"])
def test_a_row_for_each_document(docs, name):
    assert count_by_id(OPERATORS[name](docs)) == EACH


@pytest.mark.parametrize("name", list(LABELLED))
@pytest.mark.parametrize("rows", [[], SOME_LABELS])
def test_a_score_for_each_document(spark, docs, name, rows):
    out = LABELLED[name](docs, labels(spark, rows))
    assert count_by_id(out) == EACH
    assert out.where("score IS NULL OR isnan(score) OR score < 0 OR score > 1 OR predicted IS NULL OR held_out IS NULL").count() == 0
    own = "quality" if name == "op1" else "toxic"
    same = [r["score"] for r in out.where("doc_id = 1").collect()]
    assert own and same[0] == same[1]


@pytest.mark.parametrize("name", list(OPERATORS))
def test_no_rows(spark, name):
    empty = spark.createDataFrame([], DOCS)
    assert OPERATORS[name](empty).count() == 0
    for f in LABELLED.values():
        assert f(empty, labels(spark, SOME_LABELS)).count() == 0


def test_stages_without_rows(spark, tmp_path):
    labels(spark, SOME_LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        assert df.count() == 0
        df = spark.createDataFrame([], df.schema)


def test_stages_on_awkward_rows(spark, docs, tmp_path):
    labels(spark, SOME_LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    df = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, df, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == docs.columns
        df = spark.createDataFrame(df.collect(), df.schema)
    assert df.groupBy("sequence_id").count().where("count > 1").count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [0.5]), (100, [-1.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = [tuple(r) for r in mtree.op10(df).orderBy("query_id", "rank").select("query_id", "rank", "vec_id", "score").collect()]
    top = 1024 * 1024
    assert got == [
        (0, 1, 1, top), (0, 2, 2, top), (0, 3, 8, top // 2), (0, 4, 100, -top),
        (100, 1, 8, -top // 2), (100, 2, 0, -top), (100, 3, 0, -top), (100, 4, 1, -top), (100, 5, 2, -top),
    ]
    assert mtree.op10(df.limit(0)).count() == 0


def unnamed_rows():
    """Two thousand rows without an id and a hundred ids with two texts each; a line that all share, copies, and near copies."""
    line = "this line of some hundred and twenty bytes stands in every one of the documents that have no number of their own, as it were. "
    own = lambda k: " ".join(f"w{k}x{j * 7919 % 9973}" for j in range(40))
    rows = [(None, line + own(k), "en", "a", 1) for k in range(2000)]
    rows += [(k, own(3000 + k), "en", "a", 1) for k in range(100)] + [(k, line + own(4000 + k), "fr", "b", 1) for k in range(100)]
    return rows + [(None, own(3001), "en", "a", 1), (None, line + own(7), "en", "a", 1), (500, own(3002), "en", "a", 1)]


def test_repeats_without_ids_equal_brute_force(spark):
    """By value: rows in the order of id (none last) and text hash, equal rows as one document."""
    df = spark.createDataFrame(unnamed_rows(), DOCS)
    placed = sorted({(r["d"], r["th"], r["text"]) for r in suffix_dedup.keyed(df).collect()})
    seen, want = set(), {}
    for d, th, text in placed:
        raw = text.encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(raw[p : p + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[text, d] = (len(raw), sum(gone), hashlib.sha256(kept).hexdigest())
    texts = {(d, th): t for d, th, t in placed}
    got = suffix_dedup.deduplicated(df).collect()
    assert len(got) == len(unnamed_rows()) and sum(r["n_removed"] > 0 for r in got) > 2000
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == want[texts[r["d"], r["th"]], r["d"]]


def test_one_of_each_group_stays_without_ids(spark):
    """By value: of each component of fingerprints the row of the least (id, none last; MD5 of the text) stays, once."""
    rows = unnamed_rows()
    fps = {t: simhash.fingerprint(t) for _, t, *_ in rows}
    root = {f: f for f in fps.values()}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    own = sorted(root)
    for k, a in enumerate(own):
        for b in own[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    best = {}
    for i, t, *_ in rows:
        key = (i is None, i or 0, hashlib.md5(t.encode()).hexdigest(), t)
        best[find(fps[t])] = min(best.get(find(fps[t]), key), key)
    got = simhash.representatives(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in got) == sorted((n, i, t) for n, i, _, t in best.values())
