import base64
import io
import os
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semdex.config import Chunking, Indexing
from semdex.sources import code, crawl, documents, html, pdf

ARTICLE = """<html><head><title>Quiet  Rivers</title><style>x{}</style></head><body><nav><ul><li><a href=1>Home</a><li><a href=2>Shop</a></ul></nav>
<div class="sidebar">Buy things now, buy more things now</div>
<article><p>Intro text that is long enough to count as content of this page, with many plain words in it and no links at all.
<h2>Sources</h2><p>More of it follows here so that the two hundred bytes are passed without any doubt whatsoever, truly.</p>
<table><tr><th>Name</th><th>Km</th></tr><tr><td>Elm</td><td>12</td></tr></table></article>
<footer>Imprint words</footer><script>var a = 1;</script></body></html>"""


def test_html_rules():
    md = html.to_markdown("<h1>A  title</h1><p>One <b>two</b>\n three<br>four</p><ul><li>x</li><li>y</li></ul><p>e<em>f</em> g</p><script>no</script>")
    assert md == "# A title\n\nOne two three\nfour\n\n- x\n\n- y\n\nef g"
    assert html.to_markdown("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == "a | b\n\nc"
    assert html.to_markdown("<p>a &amp; b&nbsp;c") == "a & b c"
    assert html.to_markdown("") == "" and html.to_markdown(None) is None


def test_html_main_content():
    out = html.extract(ARTICLE)
    assert out.startswith("# Quiet Rivers\n\nIntro text") and "## Sources" in out and "Elm | 12" in out
    assert not any(x in out for x in ("Imprint", "Buy things", "Home", "<", "var a"))
    links = "<nav><ul>" + "".join(f"<li><a href={k}>Link {k}</a></li>" for k in range(6)) + "</ul></nav>"
    assert all(f"- Link {k}" in html.extract(links) for k in range(6))
    assert html.extract("<p> </p>") is None
    assert html.wins("x" * 200, "y" * 4000) and not html.wins("x" * 199, "y") and not html.wins("x" * 200, "y" * 4001)
    assert html.wins("é" * 100, "")


def test_deep_html():
    assert html.to_markdown("<div>" * 5000 + "x") == "x"


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="u"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


P = lambda *runs, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}' + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"
CELL = lambda inner: f"<w:tc>{inner}</w:tc>"


def test_docx():
    rows = "<w:tbl><w:tr>" + CELL(P("a")) + CELL(P("b") + P("c")) + "</w:tr><w:tr>" + CELL("<w:tbl><w:tr>" + CELL(P("in")) + "</w:tr></w:tbl>" + P("out")) + CELL(P("d")) + "</w:tr></w:tbl>"
    got = documents.docx_text(docx(P("Top", style="Title") + P("Sub", style="Heading2") + P("one ", "two") + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y &amp; &#233;</w:t></w:r></w:p>" + rows))
    assert got == "# Top\n\n## Sub\n\none two\n\nx y & é\n\na | b c\nin out | d"
    assert documents.docx_text(docx("")) is None and documents.docx_text(b"no zip") is None
    assert documents.docx_markdown(b"<a><w:p xmlns:w='u'><w:t>kept</w:t></w:p><broken") == "kept"
    assert [documents.heading_level(s) for s in ("Title", "Heading1", "heading 6", "Heading7", "Normal", "Heading")] == [1, 1, 6, 0, 0, 0]


def pdf_file(objects: dict[int, bytes], packed: tuple[int, ...] = (), extra: bytes = b"") -> bytes:
    """A file of numbered objects; those in packed lie in one compressed object stream."""
    out = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"
    for n, body in objects.items():
        if n not in packed:
            out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    if packed:
        index, bodies = b"", b""
        for n in packed:
            index += b"%d %d " % (n, len(bodies))
            bodies += objects[n] + b" "
        body = zlib.compress(index + bodies)
        head = b"<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>" % (len(packed), len(index), len(body))
        out += b"90 0 obj\n" + head + b"\nstream\r\n" + body + b"\r\nendstream\nendobj\n"
    return out + extra + b"%%EOF%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%"


def pdf_stream(body: bytes, head: bytes = b"") -> bytes:
    return b"<<" + head + b"/Length %d>>\nstream\n" % len(body) + body + b"\nendstream"


CMAP = b"""/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0003> <0020> <0010> <00660069> endbfchar
3 beginbfrange <0024> <003D> <0041> <0044> <005D> <0061> <0100> <0101> [<03B1> <D83DDE00>] endbfrange endcmap"""


@pytest.mark.parametrize("packed", [(), (1, 2, 3, 4, 6, 7)])
def test_pdf_of_objects(packed):
    """Page order and inherited fonts, a two-byte font with a character map, named glyphs, stream filters, moves in a line."""
    filler = b"(" + b"all is well here " * 15 + b") Tj T* "
    one = b"BT /F1 12 Tf 50 700 Td <0030 0048> Tj [<0003> <0010>] TJ 0 -14 Td /F2 1 Tf (caf\\001 \\002x) Tj 40 0 Td (same \\(line\\)) Tj ET BI /W 1 ID (\x00 EI "
    two = b"BT /F1 9 Tf <01000101> Tj /F2 9 Tf T* " + filler + b"ET q /X1 Do Q"
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>",
        2: b"<</Type/Pages/Kids[4 0 R 3 0 R 4 0 R]/Count 2/Resources<</Font<</F1 6 0 R/F#32 7 0 R>>/XObject<</X1 10 0 R>>>>>>",
        3: b"<</Type/Page/Parent 2 0 R/Contents 8 0 R>>",
        4: b"<</Type/Page/Parent 2 0 R/Contents[9 0 R]>>",
        6: b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 5 0 R>>",
        7: b"<</Type/Font/Subtype/Type1/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[1/eacute/uni20AC]>>>>",
        5: pdf_stream(zlib.compress(CMAP), b"/Filter/FlateDecode"),
        8: pdf_stream(base64.a85encode(two) + b"~>", b"/Filter[/ASCII85Decode]"),
        9: pdf_stream(one.hex().encode() + b">", b"/Filter/AHx"),
        10: pdf_stream(b"BT (in a form) Tj ET", b"/Type/XObject/Subtype/Form"),
    }
    got = pdf.pdf_text(pdf_file(objects, packed)).split("\n")
    assert got[:4] == ["Me fi", "café €x same (line)", "α😀", ("all is well here " * 15)]
    assert got[4:] == ["in a form"]
    # A later definition counts, and an encrypted file has no text.
    newer = b"9 0 obj\n" + pdf_stream(b"BT (newer) Tj ET") + b"\nendobj\n"
    assert pdf.pdf_text(pdf_file(objects, packed, newer)).startswith("newer\n")
    assert pdf.pdf_text(pdf_file(objects, packed, b"trailer <</Root 1 0 R/Encrypt 11 0 R>>\n")) is None


def test_pdf_oddities():
    assert pdf.lzw(bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])  # the format's own example
    loop = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Kids[2 0 R 3 0 R]>>", 3: b"3 0 R", 4: b"[[[<</A(" * 5000}
    assert pdf.pdf_text(pdf_file(loop)) is None
    assert [pdf.glyph(n) for n in ("A", "eacute", "ccedilla", "fi", "uni00410042", "u1F600", "uD800", "a.alt", "g12", "space")] == ["A", "é", "ç", "fi", "AB", "😀", "", "a", "", " "]
    assert pdf.page_text(b"BT 1 0 0 1 9 9 Tm (a) Tj ET BT 1 0 0 1 30 9 Tm (b) Tj 1 0 0 1 9 5 Tm (c\\\n) ' ET") == "a b\nc"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"1 0 obj", b"endobj", b"<<", b">>", b"[", b"]", b"(", b")", b"/Type", b"/Page", b"/Kids", b"/Contents 1 0 R", b"stream\n", b"endstream", b" 1 0 R ", b"<4", b">", b"%x", b"\n", b"trailer", b"BT (a) Tj", b"/ObjStm /First 3", b"9" * 5000, b"\xff"]), max_size=40))
def test_no_bytes_crash_the_parser(parts):
    assert isinstance(pdf.pdf_text(b"%PDF-1.4\n" + b" ".join(parts)), str | None)


def test_pdf():
    lines = ["The quarterly report (draft) says", "that all is well."] * 8
    for compress in (True, False):
        got = documents.pdf_text(documents.make_pdf(lines, compress))
        assert got.split("\n")[:2] == lines[:2]
    assert documents.pdf_text(documents.make_pdf(["short"])) is None
    assert documents.pdf_text(b"%PDF-1.4\ngarbage") is None and documents.pdf_text(b"other") is None
    assert "Hello you" in pdf.page_text(b"BT [(Hel) 20 (lo) -300 (you)] TJ ET")


@pytest.fixture
def tree(tmp_path):
    files = {
        "a.py": "x = 1\n", "__init__.py": "", ".hidden": "h", "data.bin": "a\0b", "paper.pdf": "%PDF\0", "latin.txt": None, "node_modules/m.js": "m", "src/b.txt": "b",
        "src/skip.log": "l", "src/keep.log": "k", "src/.gitignore": "*.log\n!keep.log\n/only.txt\n", "src/only.txt": "o", "src/deep/only.txt": "d", ".gitignore": "build/\n*.tmp\n# c\n",
        "build/x.txt": "x", "src/build/y.txt": "y", "t.tmp": "t", ".semdexignore": "docs/**/draft.md\n", "docs/a/draft.md": "d", "docs/a/final.md": "f",
    }
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"\xff\xfe\xe9" if text is None else text.encode())
    return tmp_path


@pytest.mark.parametrize("enough", [1, 3, 100])
def test_crawl_on_executors(spark, tree, enough, monkeypatch):
    """The same files, however many folders the driver lists; rules of upper folders hold below them."""
    for folder in ("deep/er/x", "deep/er/y", "wide"):
        os.makedirs(os.path.join(tree, folder), exist_ok=True)
        for k in range(3):
            with open(os.path.join(tree, folder, f"{k}.txt"), "w") as f:
                f.write("t" * k)
    with open(os.path.join(tree, "deep", ".gitignore"), "w") as f:
        f.write("y/\n1.txt\n")
    with open(os.path.join(tree, "deep/er/x", ".gitignore"), "w") as f:
        f.write("!1.txt\n")
    want = sorted(crawl.crawl_paths(tree))
    assert any(p.endswith("x/1.txt") for p, _, _ in want) and not any("/y/" in p for p, _, _ in want)
    real = crawl.upper_folders
    monkeypatch.setattr(crawl, "upper_folders", lambda root, config, _: real(root, config, enough))
    assert sorted(tuple(r) for r in crawl.crawl(spark, tree, few=2).collect()) == want


def test_crawl(tree):
    found = {os.path.relpath(p, tree) for p, _, _ in crawl.crawl_paths(tree)}
    assert found == {"a.py", "__init__.py", "paper.pdf", "latin.txt", "src/b.txt", "src/keep.log", "src/deep/only.txt", "docs/a/final.md"}
    assert "data.bin" in {os.path.relpath(p, tree) for p, _, _ in crawl.crawl_paths(tree, Indexing(skip_binary=False))}


def test_read_texts(spark, tree):
    (tree / "big.html").write_text("x" * 2048)
    rows = {os.path.relpath(r["file_path"], tree): r for r in crawl.read_texts(crawl.crawl(spark, tree), 0).collect()}
    assert rows["a.py"]["text"] == "x = 1\n" and rows["latin.txt"]["problem"] == "not UTF-8"
    assert rows["big.html"]["problem"] == "too large" and rows["paper.pdf"]["problem"] == "too large"
    assert crawl.find_index_root(tree) is None


def contexts(source, lang, **config):
    got = code.chunks_of(source, lang, Chunking(**config))
    return None if got is None else [c for _, c, _ in got]


def test_python_chunks():
    source = "import os\n\n# before\n@wrap\ndef f(a):\n    def inner(): pass\n    return a\n\nclass C(B):\n    '''doc'''\n    # on m\n    def m(self): return 1\n    async def n(self): pass\n"
    got = code.chunks_of(source, "python", Chunking())
    assert [c for _, c, _ in got] == ["fn::f", "class::C", "class::C::fn::m", "class::C::fn::n"]
    assert got[0][0].startswith("# before\n@wrap\ndef f") and got[2][0] == "# on m\ndef m(self): return 1"
    assert contexts("def broken(:", "python") is None and contexts("x = 1", "python") is None
    # The class is above the bound; its members are not, and stand without it.
    assert contexts(source, "python", max_chunk_tokens=8, overlap_tokens=0) == ["fn::m", "fn::n"]
    assert "class::C" in contexts(source, "python", max_chunk_tokens=8, overlap_tokens=0, rescue_oversized=True)


def test_rust_chunks():
    source = '''/// The limit.
const MAX: u32 = 3; static S: &str = "}";
// note
/// A point.
#[derive(Debug)]
pub struct Point { x: i32 }
enum E { A, B } trait T { fn t(&self); }
impl<T: Clone> Trait<T> for Point { /// gets
    pub fn get(&self) -> char { '{' } }
mod inner { pub async fn go() {} }
pub(crate) const fn free<'a>(x: &'a str) -> &'a str { x }
'''
    assert contexts(source, "rust") == [
        "const::MAX", "static::S", "struct::Point", "enum::E", "trait::T", "impl::Point", "impl::Point::function::get", "mod::inner", "mod::inner::function::go", "function::free",
    ]
    by = {c: t for t, c, _ in code.chunks_of(source, "rust", Chunking())}
    assert by["struct::Point"].startswith("/// A point.\n#[derive(Debug)]\npub struct") and by["static::S"].startswith("static")
    assert contexts("fn broken( {", "rust") is None


def test_script_chunks():
    source = '''/** Adds. */
function add(a, b) { return a + b; }
// lost
export class Store extends Base {
  // on get
  get(id) { return this.x[id]; }
  async load() { if (a) { b(); } }
}
interface Shape { area(): number }
enum Color { Red }
type Id = string | number;
const twice = (x) => { return `${x}{`; };
'''
    assert contexts(source, "typescript") == ["fn::add", "class::Store", "class::Store::method::get", "class::Store::method::load", "interface::Shape", "enum::Color", "type::Id", "fn::anonymous"]
    by = {c: t for t, c, _ in code.chunks_of(source, "typescript", Chunking())}
    assert by["fn::add"].startswith("/** Adds. */\nfunction") and by["class::Store"].startswith("class") and by["class::Store::method::get"].startswith("// on get\nget(")
    assert contexts("function f( {", "javascript") is None


def test_go_chunks():
    source = '''package p

// Limit is it.
const Limit = 3
var (
	a = 1
	b = 2
)
type Point struct { X int }
// Get gets.
func (p *Point) Get() int { return p.X }
func Free() string { return "}" }
'''
    assert contexts(source, "go") == ["const::Limit", "var::a", "type::Point", "method::Get", "fn::Free"]
    assert code.chunks_of(source, "go", Chunking())[3][0].startswith("// Get gets.\nfunc (p")


def test_deep_sources_fall_back_or_parse():
    """A long sum is one expression and no recursion of ours; what the parser itself refuses has no items."""
    long_sum = "x = " + "+".join(["1"] * 3000) + "\n\ndef f():\n    if x:\n        def g():\n            pass\n"
    got = code.python_items(long_sum)
    assert got is None or [i.name for i in got] == ["f"]
    nested = "if x:\n    try:\n        def a():\n            pass\n    except E:\n        class B:\n            def m(self):\n                pass\n"
    items = code.python_items(nested)
    assert [(i.kind, i.name, [m.name for m in i.members]) for i in items] == [("fn", "a", []), ("class", "B", ["m"])]


@pytest.mark.parametrize(
    "style,level",
    [("Title", 1), ("title", 1), (" TITLE ", 1), ("Heading1", 1), (" Heading2", 2), ("heading 3 ", 3), ("Heading 06", 6), ("Heading7", 0), ("HEADING1", 0), ("Headings1", 0), ("", 0)],
)
def test_heading_styles(style, level):
    from semdex.sources.documents import heading_level

    assert heading_level(style) == level
