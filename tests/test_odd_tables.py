"""Registered queries against their SQL on rows that the test tables lack."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalogue import QUERIES, SQL, rows

from semdex.operators import chunking
from semdex.sources import html

#: Ends of a heading that was cut after its characters were escaped, and references without their semicolon in the text.
ENDS = ["and&amp", "and&am", "and&a", "and&", "&quot", "&quo", "&lt", "&gt", "&copy", "&middot", "&#x27", "&#x2", "&#", "&ampx;", "&amp;amp", "&amp;lt;", "AT&T", "a && b", "&amp;&amp"]


#: White space that SQL's trim leaves, beside what it takes.
SPACES = ["", " ", "\n", "\t\r\n ", "\x0b", "\x0c", "\x1f", "\x85", "\u00a0", "\u2003", "\u2028", "\u3000", "\ufeff"]
TEXTS = [None, *SPACES, *(f"{a}x{a}\n{a}\n{a}{b}y{b}{a}" for a in SPACES for b in " \r\u00a0"), "a\r\n\r\nb", "\r\n\r\n", "a\n\n\n#b", "\n" * 500, "a\n" * 5000]


def page(end):
    words = "Plain words that are long enough to count as content of a page. " * 5
    return f"""<!DOCTYPE html><html><head><title>{end}</title></head><body><nav><ul><li><a href="?a=1&copy=2">Home</a></li></ul></nav>
<article><h1>{end}</h1><p>{words}{end} {words}</p></article><footer>&copy; here &middot; there</footer></body></html>"""


@pytest.fixture
def equal(spark, tmp_path):
    """Whether a query equals its SQL on one table of these rows."""

    def run(name, table, rows_, schema):
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got, want = rows(QUERIES[name](spark, str(tmp_path)).toPandas()), rows(duck.sql(SQL[name]).df())
        assert len(want) and got.to_dict("list") == want.to_dict("list")

    return run


PAGES = [(k, page(end)) for k, end in enumerate(ENDS)] + [(-1, None)]


def test_main_content_without_semicolons(equal):
    equal("html_readable", "pages", PAGES, "page_id long, html string")


def test_whole_pages_without_semicolons(equal):
    equal("html_to_markdown", "pages", PAGES, "page_id long, html string")


def test_gate_without_semicolons(equal):
    """The cut reference decides whether an article has 200 bytes."""
    articles = [f"<article><h1>{'x' * n}&amp</h1></article>" for n in range(190, 201)]
    equal("html_gate", "pages", list(enumerate(articles)), "page_id long, html string")


@pytest.mark.parametrize("name", ["split_code", "split_prose", "split_markdown"])
def test_splits_of_blank_and_null_texts(equal, name):
    equal(name, "documents", [(k, t, "en", "src0") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")


def test_split_code_of_null(spark):
    got = spark.createDataFrame([(None,), ("\n",), (" a",)], "t string").select(chunking.split_code(F.col("t"))).collect()
    assert [r[0] for r in got] == [None, ["\n"], ["a"]]


def test_references():
    """By default as HTML has them, some without a semicolon; closed, only with one."""
    assert html.to_markdown("<p>a&amp</p>") == "a&"
    for source, text in [("a&amp", "a&amp"), ("a&amp;", "a&"), ("&ampx;", "&ampx;"), ("&#65;&#x41;&#65", "AA&#65"), ("&nosuch;&eacute;", "&nosuch;é"), ("&", "&")]:
        assert html.to_markdown(html.closed_references(f"<p>{source}</p>")) == text
