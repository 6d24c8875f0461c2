import io
import json
import os
import threading

import pytest
from pyspark.sql import Row

from semdex import cli, render, rpc
from semdex.functions.embedding import HashEmbedder
from semdex.plans.indexer import Indexer, IndexStats
from semdex.service import Internal, InvalidParams, Registry, Service

HIT = [Row(file_path="/a", chunk_index=1, score=0.912, context="fn::f", content="1\n2\n3\n4"), Row(file_path="/b", chunk_index=0, score=0.5, context="", content="x"), Row(file_path="/a", chunk_index=0, score=0.4, context="", content="y")]


def test_render():
    show = lambda f, rows=HIT, kind="vector", w=(): render.render(f, "q", "/i", rows, kind, list(w))
    assert show("plain") == "/a:1\n/b:0\n/a:0" and show("filename") == "/a\n/b"
    assert show("context").startswith("Found 3 results:\n\n0.91 /a:1  fn::f\n  │ 1\n  │ 2\n  │ 3\n\n0.50 /b:0")
    assert show("context", kind="reranker").startswith("Found 3 results (reranked):")
    full = json.loads(show("json", w=["careful"]))
    assert full["warnings"] == ["careful"] and full["results"][0]["similarity"] == 0.912 and full["score_kind"] == "vector"
    assert "warnings" not in json.loads(show("json"))
    assert show("plain", []) == "No results found." and json.loads(show("json", []))["results"] == []
    assert [render.human_size(n) for n in (1023, 1024, 1 << 20)] == ["1023 bytes", "1.0 KB", "1.0 MB"]
    assert render.similar_text([]) == "No similar files found."
    assert "Est. tokens:       ~512" in render.stats_text(IndexStats("/i", "/r", 1, 2, 512, None, 5, "m", "e"))


@pytest.fixture
def roots(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.txt").write_text(f"words of {name}")
        Indexer(spark, tmp_path / name, embedder=HashEmbedder(64)).refresh(quiet=True)
    return tmp_path


def test_registry(roots):
    r = Registry.from_flags([f"x={roots / 'one'}", str(roots / "two")])
    assert r.names() == ["x", "two"] and r.resolve("two").root == roots / "two"
    with pytest.raises(ValueError, match="multiple indexes registered.*x, two"):
        r.resolve(None)
    with pytest.raises(ValueError, match="unknown index 'y'; registered indexes: x, two"):
        r.resolve("y")
    for flags, why in (([], "no indexes"), ([f"{roots}/none"], "does not exist"), ([str(roots)], "no index at"), ([f"a={roots}/one", f"a={roots}/two"], "duplicate")):
        with pytest.raises(ValueError, match=why):
            Registry.from_flags(flags)
    assert Registry.discover(roots / "one").names() == ["one"]


def test_service(spark, roots):
    s = Service(spark, Registry.from_flags([str(roots / "one"), str(roots / "two")]), lambda _: HashEmbedder(64))
    assert [(x["name"], x["files"]) for x in s.list_indexes()] == [("one", 1), ("two", 1)]
    got = s.search("words", index="one", min_similarity=0.1)
    assert got["index"] == "one" and got["results"][0]["content"] == "words of one" and "warnings" not in got and "auto_index_refreshed" not in got
    assert s.stats("two")["file_count"] == 1
    for bad in ({"min_similarity": 2.0}, {"after": "soon"}, {"index": "none"}, {}):
        with pytest.raises(InvalidParams):
            s.search("q", **bad)
    (roots / "one" / ".semdex" / "config.toml").write_text("[query]\nauto_index = true\nmin_similarity = 0.0\n")
    (roots / "one" / "g.txt").write_text("fresh words")
    assert s.search("fresh", index="one")["auto_index_refreshed"] == 1
    with s.locks["one"]:
        assert "already in flight" in s.search("fresh", index="one")["warnings"][0]
    meta = next((roots / "two" / ".semdex" / "snapshots").glob("*/meta.json"))
    meta.write_text(json.dumps(json.loads(meta.read_text()) | {"schema_version": 3}))
    with pytest.raises(Internal, match="schema v3"):
        s.search("q", index="two")
    with pytest.raises(Internal):
        Service(spark, Registry.from_flags([str(roots / "one")])).search("q", min_similarity=0.0)


def test_rpc(spark, roots):
    s = Service(spark, Registry.from_flags([str(roots / "one")]), lambda _: HashEmbedder(64))
    lines = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "words", "min_similarity": 0.0}}},
        {"id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "w", "min_similarity": 7}}}, {"id": 5, "method": "nope"},
    ]
    out = io.StringIO()
    rpc.serve_stdio(s, io.StringIO("\n".join(map(json.dumps, lines)) + "\n{bad\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert "Indexes at hand: one" in got[0]["result"]["instructions"] and len(got[1]["result"]["tools"]) == 3
    assert json.loads(got[2]["result"]["content"][0]["text"])["results"][0]["content"] == "words of one"
    assert [g["error"]["code"] for g in got[3:]] == [-32602, -32601, -32700]
    import urllib.request

    server = rpc.http_server(s, "127.0.0.1:0")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    reply = urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/mcp", json.dumps({"id": 1, "method": "ping"}).encode())
    assert json.load(reply)["result"] == {}
    server.shutdown()


def test_cli_parsing():
    a = cli.parse(["find", "the", "river", "--limit", "3", "--no-rerank", "-m", "0.2"])
    assert (a.command, a.text, a.limit, a.rerank, a.min_similarity, a.format) == ("query", ["find", "the", "river"], 3, False, 0.2, "context")
    assert cli.parse(["query", "x"]).rerank is None and cli.parse(["query", "x", "--rerank"]).rerank is True
    assert cli.parse(["mcp", "--transport", "http", "--bind", "h:1"]).bind == "h:1"
    for bad in (["x", "--rerank", "--no-rerank"], ["x", "-m", "1.5"], ["x", "--after", "soon"], ["mcp", "--bind", "h:1"], ["x", "--format", "xml"]):
        with pytest.raises(SystemExit):
            cli.parse(bad)


def test_cli(spark, tmp_path, monkeypatch):
    (tmp_path / "f.txt").write_text("river words")
    e = HashEmbedder(64)
    run = lambda *argv: (out := io.StringIO(), cli.main(list(argv), spark, e, out))[0].getvalue()
    monkeypatch.chdir(tmp_path)
    with pytest.raises(SystemExit):
        run("stats")
    assert run("index", ".") == "Indexed 1 files.\n"
    assert run("river", "words", "--format", "plain") == f"{os.path.join(tmp_path, 'f.txt')}:0\n"
    assert "Files:" in run("stats") and run("reindex") == "Indexed 1 files.\n"
    assert run("similar", "f.txt").strip() and json.loads(run("config"))["query"]["default_limit"] == 10
