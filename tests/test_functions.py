import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semdex import config as C
from semdex.functions.dates import parse_date
from semdex.functions.embedding import HashEmbedder, HttpEmbedder
from semdex.functions.similarity import cosine, cosine_to, passes
from semdex.functions.text import extension, path_contains, trim_unicode, truncate_utf8
from semdex.operators.search import SearchOptions, date_passes, plan_fetch, resolve_rerank

NOW = dt.datetime(1970, 4, 11, tzinfo=dt.timezone.utc)  # day 100


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).head()[0]


@pytest.mark.parametrize("text,days", [("7d", 7), ("2w", 14), ("3m", 90), (" 1d ", 1)])
def test_relative_dates(text, days):
    assert parse_date(text, NOW) == NOW - dt.timedelta(days=days)


def test_dates():
    assert parse_date("2024-03-05", NOW, dt.timezone(dt.timedelta(hours=2))) == dt.datetime(2024, 3, 4, 22, tzinfo=dt.timezone.utc)
    with pytest.raises(ValueError, match="too far in the past"):
        parse_date("999999d", NOW)
    with pytest.raises(ValueError, match="empty date"):
        parse_date("  ", NOW)
    for bad in ("yesterday", "d", "5x", "2024-13-01"):
        with pytest.raises(ValueError, match="could not parse"):
            parse_date(bad, NOW)


def test_date_bounds(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h, tzinfo=dt.timezone.utc)
    rows = spark.createDataFrame([(t(1),), (t(2),), (t(3),), (None,)], "m timestamp")
    count = lambda a, b: rows.where(date_passes(F.col("m"), a, b)).count()
    assert count(t(2), None) == 2  # from 2 on, 2 included
    assert count(None, t(2)) == 1  # before 2, 2 left out
    assert count(t(1), t(3)) == 2
    assert count(None, None) == 4


def test_fetch_plan_and_rerank_flag():
    assert plan_fetch(10, False, False, 50) == 10
    assert plan_fetch(5, True, False, 50) == 100
    assert plan_fetch(20, True, False, 50) == 200
    assert plan_fetch(10, False, True, 50) == 50
    assert [resolve_rerank(f, c) for f in (None, True, False) for c in (True, False)] == [True, False, True, True, False, False]
    with pytest.raises(ValueError, match="out of range"):
        SearchOptions(min_similarity=1.5)


@pytest.mark.parametrize("path,ext", [("/a/b.RS", "rs"), ("/a.b/c", ""), ("/a/.bashrc", ""), ("x.tar.gz", "gz"), ("/a/b.", "")])
def test_extension(spark, path, ext):
    assert one(spark, extension, path) == ext


def test_path_contains(spark):
    rows = spark.createDataFrame([("/src/a_b.rs",), ("/src/axb.rs",), ("/it's\\x",)], "p string")
    got = lambda part: rows.where(path_contains(F.col("p"), part)).count()
    assert [got("a_b"), got("a%b"), got("SRC"), got("it's"), got("s\\x"), got(""), got(None)] == [2, 2, 0, 1, 1, 3, 3]


def test_trim_takes_any_white_space(spark):
    assert one(spark, trim_unicode, "\u00a0\t a b\n\u2003") == "a b"


@settings(max_examples=25, deadline=None)
@given(text=st.text(alphabet="aé€😀\n", max_size=40), limit=st.integers(1, 30))
def test_truncation_splits_no_character(spark, text, limit):
    want = text.encode()[:limit].decode("utf-8", "ignore")
    assert one(spark, lambda c: truncate_utf8(c, limit), text) == want


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([float("nan"), 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.70710678) and got[1] is None and got[2] != got[2]
    assert rows.where(passes(cosine_to(F.col("a"), [1.0, 1.0]), 0.5)).count() == 1


def test_hash_embedder(spark):
    e = HashEmbedder(16)
    v = e.one(spark, "One two two\nthree")
    assert len(v) == 16 and sum(v) == 4 and e.one(spark, " ") == [0.0] * 16
    assert e.one(spark, "TWO two three one") == v


def test_config_layers(tmp_path):
    user, project = tmp_path / "user.toml", tmp_path / "p.toml"
    user.write_text('[query]\ndefault_limit = 3\nmin_similarity = 0.2\n[indexing]\nignore_patterns = ["a", "b"]\n[other]\nx = 1\n')
    project.write_text('[query]\ndefault_limit = 7\nunknown = true\n[indexing]\nignore_patterns = ["c"]\n')
    got = C.overlay(C.load_global(user), project)
    assert (got.query.default_limit, got.query.min_similarity, got.indexing.ignore_patterns) == (7, 0.2, ["c"])
    project.write_text("not toml [")
    with pytest.warns(UserWarning):
        assert C.overlay(C.Config(), project) == C.Config()
    with pytest.warns(UserWarning):
        assert C.load_global_or_default(project) == C.Config()
    with pytest.raises(ValueError):
        C.load_global(project)
    assert C.load_global(tmp_path / "absent") == C.Config()


def test_config_paths(tmp_path):
    assert str(C.global_path({"XDG_CONFIG_HOME": "/x", "HOME": "/h"})) == "/x/semdex/config.toml"
    assert str(C.global_path({"XDG_CONFIG_HOME": "", "HOME": "/h"})) == "/h/.config/semdex/config.toml"
    assert C.global_path({}) is None
    old, new = tmp_path / "old.toml", tmp_path / "a" / "new.toml"
    assert C.adopt_legacy(new, old) == new and not new.exists()
    old.write_text("[query]\n")
    assert C.adopt_legacy(new, old) == new and new.read_text() == "[query]\n"
    new.write_text("changed")
    assert C.adopt_legacy(new, old).read_text() == "changed"
    with pytest.raises(ValueError):
        C.Chunking(max_chunk_tokens=10, overlap_tokens=10)


@pytest.mark.parametrize("part_rows", [4096, 2])
def test_batch_search_by_matrix(spark, part_rows):
    """Against sorting all pairs; vectors and queries that are null, zero, not finite or of another size match nothing."""
    import numpy as np

    from semdex.operators.search import batch_search

    vectors = [[1.0, 0.0], [0.5, 0.5], [0.5, 0.5], [0.0, 0.0], [float("nan"), 1.0], None, [1.0], [-1.0, 0.2], [2.0, 2.0]]
    asked = {1: [1.0, 1.0], 2: [1.0, 0.0], 3: [0.0, -1.0], 4: [0.0, 0.0], 5: None}
    chunks = spark.createDataFrame([(f"/f{k % 4}", k, v) for k, v in enumerate(vectors)], "file_path string, chunk_index long, vector array<double>")
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query_vector array<double>")
    usable = [(f"/f{k % 4}", k, np.array(v)) for k, v in enumerate(vectors) if v is not None and len(v) == 2 and np.isfinite(v).all() and any(v)]
    want = []
    for q, x in asked.items():
        if x and any(x):
            best = sorted((-round(float(v @ x / np.linalg.norm(v) / np.linalg.norm(x)), 12), p, k) for p, k, v in usable)[:3]
            want += [(q, rank + 1, p, k, round(-s, 9)) for rank, (s, p, k) in enumerate(best) if -s >= -0.5]
    got = [(r["query_id"], r["rank"], r["file_path"], r["chunk_index"], round(r["score"], 9)) for r in batch_search(chunks, queries, 3, -0.5, part_rows=part_rows).collect()]
    assert sorted(got) == sorted(want) and len(want) > 5
    assert batch_search(chunks.limit(0), queries, 3).count() == 0 and batch_search(chunks, queries.limit(0), 3).count() == 0


def test_buckets_part_at_blanks_only():
    from semdex.functions.embedding import Buckets

    assert Buckets(1).counts("a\x1cb c\u2003d\x85e\n").tolist() == [4.0] and Buckets(4).counts(None).tolist() == [0.0] * 4


def test_remote_embedder_tries_again(monkeypatch):
    import io
    import urllib.error

    answers = [urllib.error.URLError("down"), urllib.error.HTTPError("u", 503, "busy", {}, io.BytesIO(b"wait")), b'{"data": [{"embedding": [1.0], "index": 0}]}']

    def reply(request, timeout):
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return io.BytesIO(got)

    monkeypatch.setattr("urllib.request.urlopen", reply)
    assert HttpEmbedder("http://x", "m", max_retries=2, pause=0).embed(["a"]) == [[1.0]]
    answers[:] = [urllib.error.HTTPError("u", 400, "bad", {}, io.BytesIO(b"no such model"))] * 2
    with pytest.raises(RuntimeError, match="status 400: no such model"):
        HttpEmbedder("http://x", "m", max_retries=2, pause=0).embed(["a"])
    assert len(answers) == 1
