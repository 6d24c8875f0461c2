"""Text of DOCX and PDF files, with the standard library; what has no readable text is skipped, not fatal."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdex.sources.pdf import pdf_text


def heading_level(style: str) -> int:
    """Title (in any case) is 1, Heading or heading with a number from 1 to 6 that number, anything else 0; white space around
    either part does not count."""
    style = style.strip()
    if style.lower() == "title":
        return 1
    m = re.fullmatch(r"[Hh]eading\s*\+?0*([1-6])", style)
    return int(m[1]) if m else 0


class DocxText:
    """Markdown of word/document.xml by events. Rows and cells count at table depth 1 only; deeper tables flatten into
    the cell around them."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.buffer = ""
        self.heading = 0
        self.capture = False
        self.depth = 0
        self.in_row = False
        self.cells: list[str] = []
        self.cell = ""

    def start(self, name: str, attrs: dict) -> None:
        tag = name.rpartition(":")[2]
        if tag == "tbl":
            self.depth += 1
        elif tag == "tr" and self.depth == 1:
            self.in_row, self.cells = True, []
        elif tag == "tc" and self.depth == 1:
            self.cell = ""
        elif tag == "p" and not self.in_row:
            self.buffer, self.heading = "", 0
        elif tag == "t":
            self.capture = True
        elif tag == "pStyle":
            self.heading = heading_level(next((v for k, v in attrs.items() if k.rpartition(":")[2] == "val"), ""))
        elif tag == "tab":
            self.write(" ")
        elif tag == "br":
            self.write("\n")

    def end(self, name: str) -> None:
        tag = name.rpartition(":")[2]
        if tag == "t":
            self.capture = False
        elif tag == "p":
            if self.in_row:
                if self.cell and not self.cell[-1].isspace():
                    self.cell += " "
            elif self.buffer.strip():
                self.out.append("#" * self.heading + " " * bool(self.heading) + self.buffer.strip() + "\n\n")
        elif tag == "tc" and self.depth == 1:
            self.cells.append(" ".join(self.cell.split()))
        elif tag == "tr" and self.depth == 1:
            self.out.append(" | ".join(self.cells) + "\n")
            self.in_row = False
        elif tag == "tbl":
            self.depth -= 1
            if self.depth == 0:
                self.out.append("\n")

    def text(self, data: str) -> None:
        if self.capture:
            self.write(data)

    def write(self, s: str) -> None:
        if self.in_row:
            self.cell += s
        else:
            self.buffer += s


def docx_markdown(xml: bytes) -> str:
    """What could be parsed before an error counts."""
    reader = DocxText()
    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.text
    try:
        parser.Parse(xml, True)
    except expat.ExpatError:
        pass
    return "".join(reader.out).strip()


def docx_text(raw: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            out = docx_markdown(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, OSError, zlib.error, RuntimeError):
        return None
    return out or None


def make_docx(lines: list[str]) -> bytes:
    """A minimal document: the first line a heading, the others paragraphs."""
    body = "".join(
        f'<w:p>{"<w:pPr><w:pStyle w:val=" + chr(34) + "Heading1" + chr(34) + "/></w:pPr>" if k == 0 else ""}<w:r><w:t>{escape(x)}</w:t></w:r></w:p>'
        for k, x in enumerate(lines)
    )
    xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def make_pdf(lines: list[str], compress: bool = True) -> bytes:
    """A minimal text-layer file of one page; characters outside cp1252 become question marks."""
    shown = [x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for x in lines]
    content = b"BT /F1 12 Tf 50 750 Td " + b" ".join(b"(" + s + b") Tj 0 -14 Td" for s in shown) + b" ET"
    packed = zlib.compress(content) if compress else content
    head = b"<< /Length %d %s>>" % (len(packed), b"/Filter /FlateDecode " if compress else b"")
    return b"%PDF-1.4\n1 0 obj\n" + head + b"\nstream\n" + packed + b"\nendstream\nendobj\ntrailer << >>\n%%EOF\n"


def _round_trip(docs: DataFrame, make, read) -> DataFrame:
    @F.pandas_udf("string")
    def through(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: read(make((t or "").split("\n"))))

    return docs.select("doc_id", through("text").alias("text"))


def docx_round_trip(docs: DataFrame) -> DataFrame:
    """Each text written as a DOCX file and extracted again."""
    return _round_trip(docs, make_docx, docx_text)


def pdf_round_trip(docs: DataFrame) -> DataFrame:
    """Each text written as a PDF file and extracted again; null where the text layer is too short."""
    return _round_trip(docs, make_pdf, pdf_text)
