"""Registered queries of the contracts around the search: reading, chunking by syntax, index upkeep, models, front ends.

They run over the test tables; where an index is kept, its folder goes when the application ends.
"""

from __future__ import annotations

import atexit
import datetime as dt
import shutil
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from semdex.config import Chunking, Config, Reranker, deep_merge, from_dict
from semdex.functions.embedding import HashEmbedder, HttpEmbedder
from semdex.functions.files import is_binary, utf8_text
from semdex.operators import chunking, rerank, search
from semdex.plans import catalogue, views
from semdex.plans.catalogue import ORDER, PARA, SQL_HIT, Catalogue, with_views
from semdex.plans.indexer import Indexer
from semdex.plans.searcher import Searcher
from semdex.render import render
from semdex.service import InvalidParams, Registry
from semdex.sources import code
from semdex.sources.documents import heading_level

C = Catalogue()
T = views.table


# --- Reading -------------------------------------------------------------------------------------------------------

@C.add(
    """WITH f AS (SELECT doc_id, ['txt', 'pdf', 'rs', 'HTML'][(doc_id // 3) % 4 + 1] AS ext, octet_length(encode(text)) AS n FROM documents)
    SELECT doc_id, ext IN ('txt', 'rs') AND doc_id % 3 = 0 AND n < 1024 AS binary FROM f"""
)
def binary_sniff(spark: SparkSession, d: str) -> DataFrame:
    """A zero byte after a third of the texts: seen if it lies among the first 1,024 bytes, unless text is extracted from the format."""
    ext = F.get(F.array(*map(F.lit, ("txt", "pdf", "rs", "HTML"))), (F.expr("doc_id div 3") % 4).cast("int"))
    tail = F.when(F.col("doc_id") % 3 == 0, F.lit("\0x")).otherwise(F.lit(""))
    files = T(spark, d, "documents").select("doc_id", F.concat(F.lit("/f."), ext).alias("path"), F.concat("text", tail).cast("binary").alias("content"))
    return files.select("doc_id", is_binary(F.col("path"), F.col("content")).alias("binary"))


@C.add(
    """WITH h AS (SELECT doc_id, text, hex(encode(text)) AS h, (doc_id % 400 + 1)::INTEGER AS n FROM documents)
    SELECT doc_id, CASE WHEN substr(h, 2 * n + 1, 1) NOT IN ('8', '9', 'A', 'B') OR 2 * n >= length(h) THEN decode(unhex(substr(h, 1, 2 * n))) END AS text FROM h"""
)
def utf8_read(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut after some byte: one that is cut within a character is no text."""
    cut = F.substring(F.col("text").cast("binary"), F.lit(1), (F.col("doc_id") % 400 + 1).cast("int"))
    return T(spark, d, "documents").select("doc_id", utf8_text(cut).alias("text"))


_STYLES = ("Title", "TITLE", " title ", "Heading1", "Heading 2", " heading3", "heading 6 ", "Heading7", "HEADING1", "Headings1", "Normal", "")


@C.add(
    "WITH s AS (SELECT doc_id, ['" + "', '".join(_STYLES) + f"""'][doc_id % {len(_STYLES)} + 1] AS style FROM documents)
    SELECT doc_id, CASE WHEN lower(trim(style)) = 'title' THEN 1 ELSE coalesce(try_cast(nullif(regexp_extract(trim(style), '^[Hh]eading\\s*([1-6])$', 1), '') AS INTEGER), 0) END AS level FROM s"""
)
def heading_styles(spark: SparkSession, d: str) -> DataFrame:
    level = F.udf(heading_level, "int")
    style = F.get(F.array(*map(F.lit, _STYLES)), (F.col("doc_id") % len(_STYLES)).cast("int"))
    return T(spark, d, "documents").select("doc_id", level(style).alias("level"))


# --- Chunks --------------------------------------------------------------------------------------------------------


@C.add("SELECT doc_id, 0 AS pos, text AS segment FROM documents")
def split_default(spark: SparkSession, d: str) -> DataFrame:
    parts = chunking.split_segments(F.lit("unknown"), F.col("text"))
    return T(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("pos", "segment"))


@C.add("SELECT doc_id, 0 AS pos, repeat(chr(10), (doc_id % 5 + 1)::INTEGER) AS segment FROM documents")
def split_code_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A source file of empty lines only is one segment."""
    blank = F.repeat(F.lit("\n"), (F.col("doc_id") % 5 + 1).cast("int"))
    return T(spark, d, "documents").select("doc_id", F.posexplode(chunking.split_code(blank)).alias("pos", "segment"))


@C.add("SELECT doc_id, count(*) FILTER (WHERE text <> '') AS chunks FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE trim(text) END AS text FROM documents) GROUP BY doc_id")
def blank_files(spark: SparkSession, d: str) -> DataFrame:
    """Blank content has no chunks; the others have at least one."""
    text = F.when(F.col("doc_id") % 2 == 0, F.lit(" \n\t ")).otherwise(F.col("text"))
    files = T(spark, d, "documents").select("doc_id", F.concat(F.lit("/f"), "doc_id", F.lit(".txt")).alias("file_path"), text.alias("text"))
    some = chunking.chunked(files, Chunking(max_chunk_tokens=10**6, overlap_tokens=0)).groupBy("file_path").count()
    return files.join(some, "file_path", "left").select("doc_id", F.coalesce("count", F.lit(0)).alias("chunks"))


@dataclass(frozen=True)
class Sample:
    """A source with {i} for the document's id, and the (context, content) of its chunks in order."""

    extension: str
    source: str
    chunks: tuple[tuple[str, str], ...]


SAMPLES = {
    "python": Sample(
        "py",
        "import os\n\n# about {i}\n@wrapped\ndef f{i}(a):\n    return a\n\nclass C{i}:\n    def m(self):\n        return 1\n\nif os:\n    async def late():\n        pass\n",
        (
            ("fn::f{i}", "# about {i}\n@wrapped\ndef f{i}(a):\n    return a"),
            ("class::C{i}", "class C{i}:\n    def m(self):\n        return 1"),
            ("class::C{i}::fn::m", "def m(self):\n        return 1"),
            ("fn::late", "async def late():\n        pass"),
        ),
    ),
    "rust": Sample(
        "rs",
        "use std::fmt;\n\n/// Adds {i}.\n#[inline]\npub fn add{i}(a: u8) -> u8 {\n    a + 1\n}\n\nstruct Point{i} {\n    x: f32,\n}\n\n"
        "impl fmt::Display for Point{i} {\n    fn fmt(&self) -> bool {\n        true\n    }\n}\n\nmod inner {\n    // note\n    pub const LIMIT: usize = {i};\n}\n",
        (
            ("function::add{i}", "/// Adds {i}.\n#[inline]\npub fn add{i}(a: u8) -> u8 {\n    a + 1\n}"),
            ("struct::Point{i}", "struct Point{i} {\n    x: f32,\n}"),
            ("impl::Point{i}", "impl fmt::Display for Point{i} {\n    fn fmt(&self) -> bool {\n        true\n    }\n}"),
            ("impl::Point{i}::function::fmt", "fn fmt(&self) -> bool {\n        true\n    }"),
            ("mod::inner", "mod inner {\n    // note\n    pub const LIMIT: usize = {i};\n}"),
            ("mod::inner::const::LIMIT", "pub const LIMIT: usize = {i};"),
        ),
    ),
    "javascript": Sample(
        "jsx",
        "// lost\nexport function f{i}() {\n  return \"}\";\n}\n\nconst g = (a) => {\n  return a;\n};\n",
        (("fn::f{i}", 'function f{i}() {\n  return "}";\n}'), ("fn::anonymous", "(a) => {\n  return a;\n}")),
    ),
    "typescript": Sample(
        "tsx",
        "import x from 'y';\n\n// Adds.\nfunction add{i}(a: number): number {\n  return a;\n}\n\nclass Box{i} {\n  get(): number {\n    return 1;\n  }\n}\n\n"
        "interface Shape{i} {\n  side: number;\n}\n\ntype Id{i} = string;\n",
        (
            ("fn::add{i}", "// Adds.\nfunction add{i}(a: number): number {\n  return a;\n}"),
            ("class::Box{i}", "class Box{i} {\n  get(): number {\n    return 1;\n  }\n}"),
            ("class::Box{i}::method::get", "get(): number {\n    return 1;\n  }"),
            ("interface::Shape{i}", "interface Shape{i} {\n  side: number;\n}"),
            ("type::Id{i}", "type Id{i} = string;"),
        ),
    ),
    "go": Sample(
        "go",
        "package p\n\n// Sum adds.\nfunc Sum{i}(a int) int {\n\treturn a\n}\n\ntype T{i} struct {\n\tX int\n}\n\nfunc (t T{i}) Get() int {\n\treturn t.X\n}\n\nconst Limit = {i}\n",
        (
            ("fn::Sum{i}", "// Sum adds.\nfunc Sum{i}(a int) int {\n\treturn a\n}"),
            ("type::T{i}", "type T{i} struct {\n\tX int\n}"),
            ("method::Get", "func (t T{i}) Get() int {\n\treturn t.X\n}"),
            ("const::Limit", "const Limit = {i}"),
        ),
    ),
}


def _filled(text: str) -> Column:
    return F.replace(F.lit(text), F.lit("{i}"), F.col("doc_id").cast("string"))


def _code_query(sample: Sample) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        broken = F.when(F.col("doc_id") % 9 == 0, F.lit("((\n")).otherwise(F.lit(""))
        path = F.concat(F.lit("/p/"), F.col("doc_id"), F.lit("." + sample.extension))
        files = T(spark, d, "documents").select(path.alias("file_path"), F.concat(broken, _filled(sample.source)).alias("text"))
        return code.code_chunks(files).select("file_path", "chunk_index", "context", "content")

    return run


def _code_sql(sample: Sample) -> str:
    quoted = lambda x: "replace('" + x.replace("'", "''") + "', '{i}', doc_id::VARCHAR)"
    rows = [
        f"SELECT '/p/' || doc_id || '.{sample.extension}' AS file_path, {k}::BIGINT AS chunk_index, {quoted(where)} AS context, {quoted(text)} AS content FROM documents WHERE doc_id % 9 <> 0"
        for k, (where, text) in enumerate(sample.chunks)
    ]
    return " UNION ALL ".join(rows)


for _lang, _sample in SAMPLES.items():
    # A ninth of the sources do not parse, and have no syntax chunks.
    C.queries[f"code_chunks_{_lang}"] = _code_query(_sample)
    C.sql[f"code_chunks_{_lang}"] = _code_sql(_sample)


# --- Index upkeep --------------------------------------------------------------------------------------------------

_NEW_PARA = (
    "SELECT doc_id, file_path, replace(text || CASE WHEN doc_id % 10 = 2 THEN ' changed' ELSE '' END, chr(10), chr(10) || chr(10)) AS text, source FROM doc WHERE doc_id % 10 <> 1"
)
_PLAIN = Config(chunking=Chunking(use_syntax=False))


def _folder(spark: SparkSession) -> str:
    """A folder for an index: below spark.checkpoint.dir where that is a local or mounted path."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or ""
    base = shared.removeprefix("file://") if shared.startswith(("file:", "/")) else None
    path = tempfile.mkdtemp(prefix="semdex-index-", dir=base)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files of two crawls: a tenth appears, a tenth goes, and a tenth has another text and an older time."""
    docs = views.para(spark, d)
    key = F.col("doc_id") % 10
    files = lambda df, ns, text: df.select("file_path", ns.alias("modified_ns"), F.lit(1).cast("long").alias("size"), text.alias("text"), F.lit(None).cast("string").alias("problem"))
    changed = F.when(key == 2, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    bumped = F.col("doc_id") * 1000 + F.when(key == 2, F.lit(-5)).otherwise(F.lit(0))
    return files(docs.where(key != 0), F.col("doc_id") * 1000, F.col("text")), files(docs.where(key != 1), bumped, changed)


def _indexed(spark: SparkSession, d: str) -> tuple[Indexer, list[int]]:
    """An index of the first version brought up to date with the second, and how many files each run took in."""
    ix = Indexer(spark, _folder(spark), _PLAIN, HashEmbedder(64))
    first, second = _versions(spark, d)
    taken = [ix.refresh_from(files, lambda changed: changed, quiet=True) for files in (first, second, second)]
    return ix, taken




def _id() -> Column:
    return F.regexp_extract("file_path", r"(\d+)\.txt$", 1).cast("bigint").alias("doc_id")


_CHUNKS = catalogue.C.sql["pack_default"].replace(PARA, _NEW_PARA)


@C.add(_CHUNKS)
def refresh_chunks(spark: SparkSession, d: str) -> DataFrame:
    """What an incremental run leaves is what the files hold now."""
    return _indexed(spark, d)[0].store.chunks().select(_id(), "chunk_index", "content", "token_count")


@C.add(
    f"""WITH c AS ({_CHUNKS}), n AS (SELECT doc_id, count(*) AS chunks FROM c GROUP BY doc_id)
    SELECT doc_id, doc_id * 1000 + CASE WHEN doc_id % 10 = 2 THEN -5 ELSE 0 END AS modified_ns, coalesce(chunks, 0) AS chunks FROM documents LEFT JOIN n USING (doc_id) WHERE doc_id % 10 <> 1"""
)
def refresh_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d)[0].store.manifest().select(_id(), "modified_ns", F.size("chunk_ids").cast("bigint").alias("chunks"))


@C.add(
    f"""WITH c AS ({_CHUNKS}), v AS (SELECT doc_id % 10 AS k, trim(text) <> '' AS filled FROM documents)
    SELECT (SELECT count(*) FROM v WHERE filled AND k <> 0) AS first_run, (SELECT count(*) FROM v WHERE filled AND k IN (0, 2)) AS second_run, 0::BIGINT AS third_run,
           (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM v WHERE k <> 1) AS files, (SELECT count(*) FROM v WHERE filled AND k <> 1) AS rebuilt, true AS has_size,
           true AS migrated, 0::BIGINT AS after_migration"""
)
def refresh_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files taken in by each run, by a rebuild from nothing, and what a change of the schema version leaves."""
    ix, taken = _indexed(spark, d)
    stats, second = ix.stats(), _versions(spark, d)[1]
    ix.store.wipe()
    rebuilt = ix.refresh_from(second, lambda changed: changed, quiet=True)
    meta = ix.store.current() / "meta.json"
    meta.write_text(meta.read_text().replace('"schema_version": ', '"schema_version": 9'))
    row = (*taken, stats.chunk_count, stats.file_count, rebuilt, stats.size_on_disk > 0, ix.store.migrate(), ix.store.count())
    names = "first_run long, second_run long, third_run long, chunks long, files long, rebuilt long, has_size boolean, migrated boolean, after_migration long"
    return spark.createDataFrame([row], names)


@C.add(
    f"""WITH c AS ({_CHUNKS}), v AS (SELECT doc_id, chunk_index, {catalogue._vector_sql("content")} AS v FROM c), q AS (SELECT {catalogue._vector_sql("'" + catalogue.RERANK_QUERY + "'")} AS qv)
    SELECT doc_id, chunk_index, round(list_cosine_similarity(v, qv), 6) AS score FROM v CROSS JOIN q WHERE doc_id * 1000 >= 50000 ORDER BY list_cosine_similarity(v, qv) DESC, doc_id::VARCHAR, chunk_index LIMIT 10"""
)
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """Search of the stored vectors by a text, among files of some time on."""
    ix, _ = _indexed(spark, d)
    after = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=50)
    found = Searcher(spark, ix.root, _PLAIN, HashEmbedder(64)).search(catalogue.RERANK_QUERY, search.SearchOptions(limit=10, min_similarity=0.0, after=after))
    return found.results.select(_id(), "chunk_index", F.round("score", 6).alias("score"))


# --- Models --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Sizes(HttpEmbedder):
    """Answers as a remote model would, last text first, with lengths for vectors."""

    def send(self, texts: list[str]) -> list[dict]:
        return [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in reversed(list(enumerate(texts)))]


@C.add("SELECT doc_id, length(text)::DOUBLE AS size FROM documents")
def remote_embed(spark: SparkSession, d: str) -> DataFrame:
    """Batches of a remote model, put back in order."""
    rows = _Sizes("http://localhost", "sizes", batch_size=7).column(T(spark, d, "documents"), F.col("text"), "v")
    return rows.select("doc_id", F.col("v")[0].cast("double").alias("size"))


class _Failing:
    def rerank(self, query: str, docs: list[str]) -> list[tuple[int, float]]:
        raise RuntimeError("no model")


@C.add(
    with_views(
        "doc",
        f""", h AS ({catalogue._HITS}), t AS (SELECT *, row_number() OVER ({ORDER}) AS rank FROM (SELECT * FROM h {ORDER} LIMIT 4))
    SELECT k AS kind, w AS warning, rank::INTEGER AS rank, CASE WHEN k = 'reranker' THEN 9 - chunk_of ELSE chunk_of END AS doc_id
    FROM (SELECT rank, chunk_index AS chunk_of FROM t)
    CROSS JOIN (VALUES ('vector', ''), ('vector', 'Reranking failed, using vector scores: no model')) AS v(k, w)""",
    )
)
def rerank_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Without a scorer, and with one that fails: the vector order, and in the second case a warning."""
    out = None
    for scorer in (None, _Failing()):
        rows, kind, warnings = rerank.apply_rerank(catalogue._doc_hits(spark, d), "q", 4, scorer)
        ids = [r["chunk_index"] for r in rows.collect()]
        one = spark.createDataFrame([(kind, "".join(warnings), k + 1, i) for k, i in enumerate(ids)], "kind string, warning string, rank int, doc_id long")
        out = one if out is None else out.unionByName(one)
    return out


# --- Options and front ends ----------------------------------------------------------------------------------------


@C.add("SELECT k / 100.0::DOUBLE AS value, k BETWEEN 0 AND 100 AS valid FROM range(-50, 151) AS r(k)")
def threshold_range(spark: SparkSession, d: str) -> DataFrame:
    def valid(x: float) -> bool:
        try:
            search.SearchOptions(min_similarity=x)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(k / 100, valid(k / 100)) for k in range(-50, 151)], "value double, valid boolean")


@C.add("SELECT coalesce(flag::VARCHAR, 'unset') AS flag, enabled, coalesce(flag, enabled) AS reranks FROM (VALUES (true), (false), (NULL)) AS f(flag) CROSS JOIN (VALUES (true), (false)) AS e(enabled)")
def rerank_flag(spark: SparkSession, d: str) -> DataFrame:
    rows = [("unset" if f is None else str(f).lower(), e, search.resolve_rerank(f, Reranker(enabled=e).enabled)) for f in (True, False, None) for e in (True, False)]
    return spark.createDataFrame(rows, "flag string, enabled boolean, reranks boolean")


@C.add("SELECT * FROM (VALUES ('limit', '7'), ('least', '0.2'), ('patterns', 'c'), ('format', 'context')) AS v(name, value)")
def config_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The project's values over the user's over the defaults; tables merge, arrays are replaced, unknown keys are passed over."""
    user = {"query": {"default_limit": 3, "min_similarity": 0.2}, "indexing": {"ignore_patterns": ["a", "b"]}}
    project = {"query": {"default_limit": 7, "unknown": True}, "indexing": {"ignore_patterns": ["c"]}}
    c = from_dict(deep_merge(user, project))
    rows = [("limit", c.query.default_limit), ("least", c.query.min_similarity), ("patterns", ",".join(c.indexing.ignore_patterns)), ("format", c.query.output_format)]
    return spark.createDataFrame([(n, str(v)) for n, v in rows], "name string, value string")


@C.add(with_views("idx", "SELECT coalesce(CASE WHEN vec_id % 3 <> 0 THEN file_path END, 'unknown') AS file_path, coalesce(CASE WHEN vec_id % 5 <> 0 THEN chunk_index END, 0) AS chunk_index, 0.5::DOUBLE AS score, '' AS context, '' AS content FROM idx"))
def result_defaults(spark: SparkSession, d: str) -> DataFrame:
    path, index = F.when(F.col("vec_id") % 3 != 0, F.col("file_path")), F.when(F.col("vec_id") % 5 != 0, F.col("chunk_index"))
    return search.result_rows(views.idx(spark, d).select(path.alias("file_path"), index.alias("chunk_index"), F.lit(0.5).alias("score")))


_LINES = "a\nb\nc\nd"


@C.add(
    with_views(
        "idx scored",
        f""", t AS (SELECT *, row_number() OVER ({ORDER}) AS rank FROM (SELECT * FROM scored {ORDER} LIMIT 8)),
    u AS (SELECT file_path, min(rank) AS rank FROM t GROUP BY file_path), n AS (SELECT count(*) AS n FROM t),
    l AS (SELECT rank, unnest(['', printf('%.2f', s) || ' ' || file_path || ':' || chunk_index || '  fn::f', '  │ a', '  │ b', '  │ c']) AS line, generate_subscripts(range(5), 1) AS k FROM t)
    SELECT 'plain' AS format, rank::INTEGER AS n, file_path || ':' || chunk_index AS line FROM t
    UNION ALL SELECT 'filename', (row_number() OVER (ORDER BY rank))::INTEGER, file_path FROM u
    UNION ALL SELECT 'context', 1, 'Found ' || n || ' results:' FROM n
    UNION ALL SELECT 'context', ((rank - 1) * 5 + k + 1)::INTEGER, line FROM l
    UNION ALL SELECT 'reranked', 1, 'Found ' || n || ' results (reranked):' FROM n
    UNION ALL SELECT 'none', 1, 'No results found.'""",
    )
)
def render_formats(spark: SparkSession, d: str) -> DataFrame:
    found = search.vector_search(views.idx(spark, d), views.query_vector(spark, d), 8, -1.0).drop("vector")
    rows = search.result_rows(found.withColumns({"content": F.lit(_LINES), "context": F.lit("fn::f")})).collect()
    shown = {f: render(f, "q", "/i", rows, "vector", []) for f in ("plain", "filename", "context")}
    shown |= {"reranked": render("context", "q", "/i", rows, "reranker", []).split("\n")[0], "none": render("plain", "q", "/i", [], "vector", [])}
    lines = [(f, k + 1, line) for f, text in shown.items() for k, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(lines, "format string, n int, line string")


@C.add("SELECT * FROM (VALUES ('one', 'one'), ('none', 'InvalidParams'), ('missing', 'InvalidParams')) AS v(asked, got)")
def index_registry(spark: SparkSession, d: str) -> DataFrame:
    """Indexes by name: a known one, an unknown one, and none where there are two."""
    from pathlib import Path

    from semdex.service import Entry, Service

    service = Service(spark, Registry([Entry("one", Path("/nowhere/1")), Entry("two", Path("/nowhere/2"))]))
    rows = []
    for asked, name in (("one", "one"), ("none", "other"), ("missing", None)):
        try:
            rows.append((asked, service._entry(name).name))
        except InvalidParams:
            rows.append((asked, "InvalidParams"))
    return spark.createDataFrame(rows, "asked string, got string")


def queries() -> dict[str, catalogue.Query]:
    return dict(C.queries)


def oracle_sql() -> dict[str, str]:
    return dict(C.sql)
