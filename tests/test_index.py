import json
import os

import pytest
from pyspark.sql import functions as F

from semdex.config import Config
from semdex.functions.embedding import HashEmbedder, HttpEmbedder, PrecomputedEmbedder
from semdex.operators.rerank import LexicalReranker, apply_rerank
from semdex.operators.search import SearchOptions
from semdex.plans.indexer import Indexer
from semdex.plans.searcher import Searcher
from semdex.plans.store import SchemaMismatch, Store, manifest_from_json

DEAD = HttpEmbedder("http://127.0.0.1:1/embeddings", "dead", timeout=2)


@pytest.fixture
def project(tmp_path):
    (tmp_path / "rivers.txt").write_text("The river flows to the sea.\n\nBoats sail the river.")
    (tmp_path / "hills.md").write_text("# Hills\nGreen hills and sheep.\n\n# Sheep\nSheep eat grass.")
    (tmp_path / "m.py").write_text("class A:\n    def river(self):\n        return 'river'\n")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "latin.txt").write_bytes(b"\xff\xe9")
    return tmp_path


def indexer(spark, root, embedder=None):
    return Indexer(spark, root, Config(), embedder or HashEmbedder(256))


def paths(df):
    return sorted({os.path.basename(r["file_path"]) for r in df.select("file_path").collect()})


def test_refresh(spark, project):
    ix = indexer(spark, project)
    assert ix.refresh() == 3
    assert paths(ix.store.manifest()) == ["blank.txt", "hills.md", "m.py", "rivers.txt"]
    assert paths(ix.store.chunks()) == ["hills.md", "m.py", "rivers.txt"]
    first = ix.store.current()
    assert ix.refresh(quiet=True) == 0
    kept = {r["id"] for r in ix.store.chunks().where(F.col("file_path").endswith("m.py")).collect()}
    (project / "rivers.txt").write_text("The lake is still.")
    os.utime(project / "rivers.txt", ns=(1, 1))  # a clock set back still counts as a change
    (project / "hills.md").unlink()
    (project / "new.txt").write_text("Brand new.")
    assert ix.refresh(quiet=True) == 2
    assert paths(ix.store.chunks()) == ["m.py", "new.txt", "rivers.txt"]
    texts = [r["content"] for r in ix.store.chunks().where(F.col("file_path").endswith("rivers.txt")).collect()]
    assert texts == ["The lake is still."]
    assert kept == {r["id"] for r in ix.store.chunks().where(F.col("file_path").endswith("m.py")).collect()}
    assert first != ix.store.current()
    s = ix.stats()
    assert (s.file_count, s.chunk_count) == (4, ix.store.count()) and s.size_on_disk > 0 and s.estimated_tokens == 256 * s.chunk_count


def test_failed_run_leaves_the_last_snapshot(spark, project):
    ix = indexer(spark, project)
    ix.refresh()
    before, count = ix.store.current(), ix.store.count()
    (project / "more.txt").write_text("More words here.")
    with pytest.raises(Exception):
        indexer(spark, project, DEAD).refresh()
    assert ix.store.current() == before and ix.store.count() == count
    assert ix.refresh() == 1 and ix.store.count() == count + 1


def test_schema_migration(spark, project):
    ix = indexer(spark, project)
    ix.refresh()
    (project / ".semdex" / "config.toml").write_text("[query]\ndefault_limit = 2\n")
    meta = ix.store.current() / "meta.json"
    meta.write_text(json.dumps(json.loads(meta.read_text()) | {"schema_version": 4}))
    with pytest.raises(RuntimeError, match="schema is outdated"):
        ix.refresh(quiet=True)
    assert ix.store.current() is not None
    assert ix.refresh() == 3
    ix.store.wipe()
    assert ix.store.current() is None and (project / ".semdex" / "config.toml").exists()
    with pytest.raises(FileNotFoundError):
        ix.store.mtimes()


def test_other_models_are_refused(spark, project):
    indexer(spark, project).refresh()
    with pytest.raises(SchemaMismatch):
        Searcher(spark, project, Config(), HashEmbedder(32)).search("river")


def test_search(spark, project):
    ix = indexer(spark, project)
    ix.refresh()
    s = Searcher(spark, project, Config(), HashEmbedder(256), LexicalReranker())
    found = s.search("the river", SearchOptions(min_similarity=0.1))
    rows = found.results.collect()
    assert rows[0]["file_path"].endswith("rivers.txt") and found.score_kind == "vector"
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert s.search("the river", SearchOptions(min_similarity=0.1, path_contains="m.py")).results.count() <= 2
    assert s.search("the river", SearchOptions(limit=0, min_similarity=0.0)).results.count() == 0
    reranked = s.search("sheep", SearchOptions(min_similarity=0.0, rerank=True, limit=1))
    assert reranked.score_kind == "reranker" and "heep" in reranked.results.head()["content"]
    from semdex.functions.dates import parse_date

    assert s.search("river", SearchOptions(min_similarity=0.0, after=parse_date("1d"))).results.count() > 0
    assert s.search("river", SearchOptions(min_similarity=0.0, before=parse_date("1d"))).results.count() == 0
    other = [r["file_path"] for r in s.similar(project / "rivers.txt").collect()]
    assert other and not any(p.endswith("rivers.txt") for p in other)
    with pytest.raises(ValueError, match="empty"):
        s.similar(project / "blank.txt")


def test_rerank_fallback(spark):
    hits = spark.createDataFrame([("/a", 0, 0.9, "", "x"), ("/b", 0, 0.8, "", "y"), ("/c", 0, 0.7, "", "z")], "file_path string, chunk_index long, score double, context string, content string")

    class Broken:
        def rerank(self, query, docs):
            raise RuntimeError("no route")

    class Odd:
        def rerank(self, query, docs):
            return [(2, 5.0), (9, 9.0), (0, float("nan")), (1, 6.0)]

    rows, kind, warnings = apply_rerank(hits, "q", 2, Broken())
    assert [r["file_path"] for r in rows.collect()] == ["/a", "/b"] and kind == "vector"
    assert warnings == ["Reranking failed, using vector scores: no route"]
    rows, kind, warnings = apply_rerank(hits, "q", 5, Odd())
    assert [r["file_path"] for r in rows.collect()] == ["/b", "/c", "/a"] and kind == "reranker" and not warnings
    assert apply_rerank(hits.limit(0), "q", 5, Odd())[1] == "vector"
    assert apply_rerank(hits, "q", 5, None)[1:] == ("vector", [])


def test_json_manifest(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"version": 5, "files": {"/a": {"modified_at": {"secs_since_epoch": 3, "nanos_since_epoch": 7}, "chunk_ids": ["u"]}}}))
    version, rows = manifest_from_json(spark, str(path))
    assert version == 5 and rows.select("file_path", "modified_ns", "chunk_ids").collect() == [("/a", 3_000_000_007, ["u"])]
    path.write_text(json.dumps({"files": {}}))
    assert manifest_from_json(spark, str(path))[0] == 0


def test_http_embedder_and_precomputed(spark):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            data = [{"embedding": [float(len(t)), 1.0], "index": k} for k, t in enumerate(texts)]
            body = json.dumps({"data": data[::-1][: 1 if "short" in texts else None]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = HttpEmbedder(f"http://127.0.0.1:{server.server_port}/e", "m", batch_size=2)
    rows = spark.createDataFrame([("a",), ("bb",), ("ccc",)], "t string").coalesce(1)
    assert [r["v"] for r in e.column(rows, F.col("t"), "v").collect()] == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]]
    with pytest.raises(RuntimeError, match="1 embeddings for 2"):
        e.embed(["short", "x"])
    server.shutdown()
    known = PrecomputedEmbedder(spark.createDataFrame([("a", [1.0])], "text string, vector array<double>"))
    assert known.column(rows, F.col("t"), "v").count() == 1 and known.one(spark, "a") == [1.0]


def test_streaming_ingest(spark, tmp_path):
    from semdex.streaming.ingest import ingest

    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put = lambda name, text: spark.createDataFrame([(name, text)], "file_path string, text string").write.mode("append").parquet(source)
    run = lambda: ingest(spark, source, sink, mark, Config(), HashEmbedder(8)).awaitTermination(60)
    put("/a.txt", "one two")
    assert run() and spark.read.parquet(sink).count() == 1
    put("/b.txt", "three")
    assert run() and sorted(r["file_path"] for r in spark.read.parquet(sink).collect()) == ["/a.txt", "/b.txt"]


def test_store_of_nothing(spark, tmp_path):
    s = Store(spark, tmp_path)
    assert s.count() == 0 and s.meta() is None and s.size_on_disk() == 0


def test_a_run_writes_what_changed_and_parts_are_merged(spark, tmp_path):
    """Old parts stay as they are while mostly live; a mostly dead part and too many parts are merged; every state reads right."""
    from pyspark.sql import Row

    from semdex.plans import store as stored

    texts, ix = {f"/f{k}": f"text {k}" for k in range(20)}, Indexer(spark, tmp_path, Config(), HashEmbedder(8))
    clock = {p: 1000 for p in texts}

    def run():
        rows = [Row(file_path=p, modified_ns=clock[p], size=1, text=t, problem=None) for p, t in texts.items()]
        files = spark.createDataFrame(rows, "file_path string, modified_ns long, size long, text string, problem string")
        ix.refresh_from(files, lambda changed: changed, quiet=True)
        assert {r["file_path"]: r["content"] for r in ix.store.chunks().collect()} == texts
        assert {r["file_path"] for r in ix.store.manifest().collect()} == set(texts) and ix.store.count() == len(texts)
        return ix.store.meta()

    first = run()
    base = next(iter(first.parts))
    for turn in range(stored.MAX_PARTS + 2):
        texts[f"/f{turn % 3}"], clock[f"/f{turn % 3}"] = f"turn {turn}", 2000 + turn
        meta = run()
        assert base in meta.parts and meta.dead[:1] == [base] and len(meta.parts) <= stored.MAX_PARTS
    for k in range(3, 16):
        del texts[f"/f{k}"]
    meta = run()
    assert base not in meta.parts and not meta.dead
    listed = {n for m in (tmp_path / ".semdex" / "snapshots").glob("*/meta.json") for n in json.loads(m.read_text())["parts"]}
    assert {p.name for p in (tmp_path / ".semdex" / "chunks").iterdir()} == listed


def test_sources_are_parsed_once(spark, tmp_path):
    files = spark.createDataFrame([("/a.py", "def f():\n    pass\n"), ("/b.py", "x = 1\n"), ("/c.txt", "plain")], "file_path string, text string")
    from semdex.plans.indexer import all_chunks

    cut = all_chunks(files, Config())
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    assert {(r["file_path"], r["context"], r["content"]) for r in cut.collect()} == {("/a.py", "fn::f", "def f():\n    pass"), ("/b.py", "", "x = 1"), ("/c.txt", "", "plain")}
