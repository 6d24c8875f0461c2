"""Syntax chunks of source files: an item and, one level deeper, its members.

Python goes through the standard parser. Rust, JavaScript, TypeScript and Go go through a lexical scan that masks strings and
comments and matches brackets; what does not balance has no syntax chunks, and is split as text instead. An item above the
token bound is left out, its members are not (without it in their path); rescue_oversized cuts it into windows instead.
"""

from __future__ import annotations

import ast
import bisect
import logging
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdex.config import Chunking
from semdex.functions.tokenizer import tokenizer
from semdex.operators.chunking import numbered
from semdex.operators.routing import language

LOG = logging.getLogger("semdex")


@dataclass
class Item:
    kind: str
    name: str
    begin: int
    end: int
    lead: str
    members: list[Item]


def python_items(source: str) -> list[Item] | None:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = source.splitlines(keepends=True)
    raw = [line.encode() for line in lines]
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))

    def at(line: int, col: int) -> int:
        return starts[line - 1] + len(raw[line - 1][:col].decode("utf-8", "ignore"))

    def lead(first_line: int) -> str:
        k = first_line - 1
        while k > 0 and lines[k - 1].lstrip().startswith("#"):
            k -= 1
        return "\n".join(line.strip() for line in lines[k : first_line - 1])

    def members(body: list) -> list[Item]:
        """Functions and classes of a body and of the statements in it, in order; a stack, so that depth costs no recursion."""
        found = []
        waiting = list(reversed(body))
        while waiting:
            node = waiting.pop()
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                top = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                line = lines[top - 1]
                begin = starts[top - 1] + len(line) - len(line.lstrip())
                is_class = isinstance(node, ast.ClassDef)
                found.append(
                    Item("class" if is_class else "fn", node.name, begin, at(node.end_lineno, node.end_col_offset), lead(top), members(node.body) if is_class else [])
                )
            elif not isinstance(node, ast.expr):
                waiting += reversed([c for c in ast.iter_child_nodes(node) if not isinstance(c, ast.expr)])
        return found

    return members(tree.body)


PAIRS = {"(": ")", "[": "]", "{": "}"}
LEX = {
    "rust": re.compile(r"//[^\n]*|/\*.*?\*/|r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\[^\n]{1,10}?|[^'\\\n])'", re.S),
    "go": re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\[^\n]{1,10}?|[^'\\\n])'", re.S),
}
LEX["javascript"] = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
LEX["typescript"] = LEX["tsx"] = LEX["javascript"]


class Scan:
    """Masked text of the same length, comments, and the partner of each bracket; None of brackets if they do not balance."""

    def __init__(self, source: str, lang: str):
        self.source = source
        self.comments: list[tuple[int, int]] = []

        def mask(m: re.Match) -> str:
            if m[0].startswith(("//", "/*")):
                self.comments.append(m.span())
                return re.sub(r"[^\n]", " ", m[0])
            return m[0][0] + re.sub(r"[^\n]", "_", m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0]

        self.text = LEX[lang].sub(mask, source)
        self.partner: dict[int, int] | None = {}
        self.opening: dict[int, int] = {}
        stack: list[int] = []
        for k, ch in enumerate(self.text):
            if ch in PAIRS:
                stack.append(k)
            elif ch in ")]}":
                if not stack or PAIRS[self.text[stack[-1]]] != ch:
                    self.partner = None
                    return
                self.opening[k] = stack[-1]
                self.partner[stack.pop()] = k
        if stack:
            self.partner = None

    def body(self, begin: int, end: int) -> int | None:
        """The first { of a header, brackets skipped; None if a ; or the end comes first."""
        k = begin
        while k < end:
            ch = self.text[k]
            if ch == "{":
                return k
            if ch == ";":
                return None
            k = self.partner[k] + 1 if ch in "([" else k + 1
        return None

    def statement_end(self, begin: int, end: int, lines: bool) -> int:
        """After the ; that ends a statement or, if lines end statements, at its line's end; brackets skipped."""
        k = begin
        while k < end:
            ch = self.text[k]
            if ch == ";":
                return k if lines else k + 1
            if ch == "\n" and lines:
                return k
            k = self.partner[k] + 1 if ch in PAIRS else k + 1
        return end

    def lead(self, begin: int, low: int, keep) -> str:
        """The comments right above a place, white space between, that ``keep`` accepts, in order."""
        found: list[str] = []
        k = bisect.bisect_left(self.comments, (begin,)) - 1
        top = begin
        while k >= 0 and self.comments[k][0] >= low and not self.text[self.comments[k][1] : top].strip():
            a, b = self.comments[k]
            if not keep(self.source[a:b]):
                break
            found.append(self.source[a:b])
            top = a
            k -= 1
        return "\n".join(reversed(found))


RUST = re.compile(
    r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|unsafe|extern(?:\s*\"[^\"]*\")?|const(?=\s+(?:unsafe\s+|async\s+|extern\s+)*fn\b))\s+)*(?P<kw>fn|struct|enum|trait|impl|mod|const|static)\b"
)
RUST_KIND = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "mod": "mod", "const": "const", "static": "static"}
SCRIPT = re.compile(
    r"(?:async\s+)?function\s*\*?\s*(?P<fn>[\w$]*)|(?:abstract\s+)?class\s+(?P<cls>[\w$]+)|interface\s+(?P<iface>[\w$]+)|(?:const\s+)?enum\s+(?P<enum>[\w$]+)|type\s+(?P<type>[\w$]+)(?=[^=;\n]*=)"
    r"|(?:async\s+)?(?:\((?P<args>)|(?P<one>[\w$]+)(?=\s*=>))"
)
METHOD = re.compile(r"(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*\*?\s*(?P<name>#?[\w$]+)\s*(?:<[^>]*>)?\(")
NOT_METHODS = frozenset("if for while switch catch function return new super constructor_".split())
GO = re.compile(r"(?P<kw>func|type|const|var)\b")


def rust_items(scan: Scan, low: int, high: int) -> list[Item]:
    found, k = [], low
    while k < high:
        ch = scan.text[k]
        if ch in PAIRS:
            k = scan.partner[k] + 1
            continue
        m = RUST.match(scan.text, k) if not (k and (scan.text[k - 1].isalnum() or scan.text[k - 1] == "_")) else None
        if not m:
            k += 1
            continue
        kw = m["kw"]
        brace = scan.body(m.end(), high)
        ends_plain = kw in ("const", "static")
        end = scan.statement_end(m.end(), high, False) if ends_plain or brace is None else scan.partner[brace] + 1
        head = scan.source[m.end() : brace if brace is not None and not ends_plain else end]
        if kw == "impl":
            plain = re.sub(r"^\s*<(?:[^<>]|<[^<>]*>)*>", "", head)
            plain = re.split(r"\bwhere\b", plain)[0]
            name = re.split(r"\bfor\b", plain)[-1].strip() or "anonymous"
        else:
            got = re.match(r"\s*(?:mut\s+)?(\w+)", head)
            name = got[1] if got else "anonymous"
        members = rust_items(scan, brace + 1, end - 1) if kw in ("impl", "mod") and brace is not None else []
        lead, top = [], m.start()
        while True:
            doc = scan.lead(top, low, lambda c: c.startswith("///"))
            if doc:
                lead.insert(0, doc)
                top = scan.source.rfind(doc.split("\n")[0], low, top)
            before = scan.text[low:top].rstrip()
            if before.endswith("]"):
                opened = scan.opening.get(low + len(before) - 1)
                if opened is not None and opened > low and scan.text[opened - 1] == "#":
                    lead.insert(0, scan.source[opened - 1 : low + len(before)])
                    top = opened - 1
                    continue
            break
        found.append(Item(RUST_KIND[kw], name, m.start(), end, "\n".join(lead), members))
        k = end
    return found


def class_members(scan: Scan, low: int, high: int) -> list[Item]:
    found, k = [], low
    while k < high:
        ch = scan.text[k]
        at_word = re.match(r"[\w$*#]", ch) and not (k and re.match(r"[\w$.#]", scan.text[k - 1]))
        m = METHOD.match(scan.text, k) if at_word else None
        if m and m["name"] not in NOT_METHODS:
            close = scan.partner[m.end() - 1]
            brace = scan.body(close + 1, high)
            if brace is not None and re.fullmatch(r"\s*(?::[^;{}=]*)?", scan.text[close + 1 : brace]):
                end = scan.partner[brace] + 1
                found.append(Item("method", m["name"], m.start(), end, scan.lead(m.start(), low, lambda c: True), []))
                k = end
                continue
        k = scan.partner[k] + 1 if ch in PAIRS else k + 1
    return found


def script_items(scan: Scan, low: int, high: int) -> list[Item]:
    found, k = [], low
    while k < high:
        at_word = not (k and re.match(r"[\w$.]", scan.text[k - 1]))
        m = SCRIPT.match(scan.text, k) if at_word or scan.text[k] == "(" else None
        if not m:
            k += 1
            continue
        exported = re.search(r"\bexport\s+(?:default\s+)?$", scan.text[low : m.start()])
        lead = "" if exported else scan.lead(m.start(), low, lambda c: True)
        if m["args"] is not None or m["one"]:
            close = scan.partner[m.end() - 1] if m["args"] is not None else m.end() - 1
            arrow = re.compile(r"\s*(?::[^=;{}]*)?=>\s*").match(scan.text, close + 1)
            if not arrow:
                k = m.end()
                continue
            end = scan.partner[arrow.end()] + 1 if scan.text[arrow.end() : arrow.end() + 1] == "{" else scan.statement_end(arrow.end(), high, True)
            found.append(Item("fn", "anonymous", m.start(), end, "", []))
            k = end
            continue
        if m["type"]:
            end = scan.statement_end(m.end(), high, False)
            found.append(Item("type", m["type"], m.start(), end, lead, []))
            k = end
            continue
        brace = scan.body(m.end(), high)
        if brace is None:
            k = m.end()
            continue
        end = scan.partner[brace] + 1
        if m["cls"]:
            found.append(Item("class", m["cls"], m.start(), end, lead, class_members(scan, brace + 1, end - 1)))
        elif m["iface"] or m["enum"]:
            found.append(Item("interface" if m["iface"] else "enum", m["iface"] or m["enum"], m.start(), end, lead, []))
        else:
            found.append(Item("fn", m["fn"] or "anonymous", m.start(), end, lead, []))
        k = end
    return found


def go_items(scan: Scan, low: int, high: int) -> list[Item]:
    found, k = [], low
    while k < high:
        ch = scan.text[k]
        if ch in PAIRS:
            k = scan.partner[k] + 1
            continue
        m = GO.match(scan.text, k) if not (k and (scan.text[k - 1].isalnum() or scan.text[k - 1] in "_.")) else None
        if not m:
            k += 1
            continue
        kw, begin = m["kw"], m.end()
        if kw == "func":
            receiver = re.compile(r"\s*\(").match(scan.text, begin)
            after = scan.partner[receiver.end() - 1] + 1 if receiver else begin
            got = re.compile(r"\s*(\w+)").match(scan.text, after)
            brace = scan.body(after, high)
            end = scan.partner[brace] + 1 if brace is not None else scan.statement_end(after, high, True)
            found.append(Item("method" if receiver else "fn", got[1] if got else "anonymous", m.start(), end, scan.lead(m.start(), low, lambda c: True), []))
        else:
            got = re.compile(r"\s*\(?\s*(\w+)").match(scan.text, begin)
            end = scan.statement_end(begin, high, True)
            found.append(Item(kw, got[1] if got else "anonymous", m.start(), end, scan.lead(m.start(), low, lambda c: True), []))
        k = end
    return found


def items_of(source: str, lang: str) -> list[Item] | None:
    """Items of a file; None if it cannot be parsed or has none."""
    if lang == "python":
        return python_items(source) or None
    if lang not in LEX:
        return None
    scan = Scan(source, lang)
    if scan.partner is None:
        return None
    find = {"rust": rust_items, "go": go_items}.get(lang, script_items)
    return find(scan, 0, len(source)) or None


def chunks_of(source: str, lang: str, config: Chunking) -> list[tuple[str, str, int]] | None:
    """(content, context, tokens) of a file in order, or None."""
    items = items_of(source, lang)
    if items is None:
        return None
    out: list[tuple[str, str, int]] = []
    tokens = tokenizer(config.tokenizer)

    def emit(item: Item, path: str) -> None:
        text = source[item.begin : item.end]
        content = f"{item.lead}\n{text}" if item.lead else text
        n = tokens.count(content)
        inner = f"{path}::{item.kind}::{item.name}" if path else f"{item.kind}::{item.name}"
        if n <= config.max_chunk_tokens:
            out.append((content, inner, n))
        else:
            if config.rescue_oversized:
                out.extend((part, inner, k) for part, k in tokens.windows(content, config.max_chunk_tokens, config.overlap_tokens))
            inner = path
        for member in item.members:
            emit(member, inner)

    for item in items:
        emit(item, "")
    return out or None


PIECES = "array<struct<content: string, n: int, context: string>>"


def syntax_pieces(path: Column, text: Column, config: Chunking) -> Column:
    """Array of (content, n, context) of a file in a supported language; null where it has no syntax chunks. Other files' texts do
    not go to Python, and a file that the parser fails on counts as one without items."""
    wanted = set(config.languages) | ({"tsx"} if "typescript" in config.languages else set())
    lang = language(path)

    @F.pandas_udf(PIECES)
    def found(texts: pd.Series, langs: pd.Series) -> pd.Series:
        out: list[list[dict] | None] = []
        for source, name in zip(texts, langs):
            chunks = None
            if source is not None:
                try:
                    chunks = chunks_of(source, name, config)
                except (RecursionError, ValueError, IndexError, KeyError) as e:
                    LOG.warning("a %s file has no syntax chunks: %s", name, e)
            out.append(None if chunks is None else [{"content": c, "n": n, "context": where} for c, where, n in chunks])
        return pd.Series(out, dtype=object)

    return found(F.when(lang.isin(*wanted), text), lang)


def code_chunks(files: DataFrame, config: Chunking | None = None) -> DataFrame:
    """Syntax chunks of files (file_path, text) in a supported language; files without any have no rows."""
    return numbered(files.select("file_path", syntax_pieces(F.col("file_path"), F.col("text"), config or Chunking()).alias("pieces")))
