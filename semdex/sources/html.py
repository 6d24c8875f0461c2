"""HTML to Markdown-like text: the whole page, or its main content where that is enough of the page."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from semdex.functions.text import trim_unicode

# Tags without output, block tags, tags without content.
DROPPED = frozenset("script style noscript template head".split())
BLOCKS = frozenset("p div section article ul ol li table tr blockquote pre header footer main aside figure figcaption nav".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
LEAST_BYTES, LEAST_SHARE = 200, 20

#: Parts of a page beside its content, by tag and by words of class or id.
ASIDE_TAGS = frozenset("nav aside footer header form".split())
ASIDE_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|banner|breadcrumbs?|comments?|cookie|menu|newsletter|promo|related|share|sharing|sidebar|social|sponsor)(?:$|[\s_-])", re.I)
CONTENT_TAGS = frozenset("article main section div body".split())


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)


class TreeBuilder(HTMLParser):
    """A tolerant tree: a block start closes an open paragraph, a list item or cell its like; stray ends are passed over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        top = self.open[-1].tag
        if (top == "p" and (tag in BLOCKS or tag in HEADINGS)) or (tag == top and tag in ("li", "td", "th", "tr")):
            self.open.pop()
        if tag == "body":
            self.open = [n for n in self.open if n.tag != "head"]
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


#: An ampersand with the reference that it starts, if a semicolon ends one.
REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def closed_references(html: str) -> str:
    """A page whose references need their semicolon: other ampersands are escaped, so that a cut "&amp" stays as it is.

    HTML itself also takes numbers and a hundred old names without one, as the functions here do by default.
    """
    return REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}", html)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


class Writer:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.pending = False

    def put(self, s: str) -> None:
        if s:
            self.parts.append(s)

    def tail(self) -> str:
        return self.parts[-1][-1] if self.parts else ""

    def block_break(self) -> None:
        """Exactly one blank line after what there is, if there is anything."""
        self.pending = False
        while self.parts:
            kept = self.parts.pop().rstrip(" \n")
            if kept:
                self.parts.append(kept)
                break
        if self.parts:
            self.parts.append("\n\n")

    def text(self, s: str) -> None:
        words = s.split()
        if not words:
            self.pending = self.pending or bool(s)
            return
        if (self.pending or s[0].isspace()) and self.parts and not self.tail().isspace():
            self.put(" ")
        self.put(" ".join(words))
        self.pending = s[-1].isspace()

    def finished(self) -> str:
        out = "".join(self.parts)
        lines = [re.sub(r"\|+$", "", line.rstrip()).rstrip() for line in out.split("\n")]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def written(root: Node, skip: frozenset = frozenset()) -> str:
    """Markdown of a subtree; ids of nodes in skip are left out. A stack in place of recursion: pages nest without bound."""
    w = Writer()
    stack: list = [(root, True)]
    while stack:
        node, opening = stack.pop()
        if isinstance(node, str):
            w.text(node)
            continue
        tag = node.tag
        if tag in DROPPED or id(node) in skip:
            continue
        if opening:
            if tag in HEADINGS:
                w.block_break()
                w.put("#" * HEADINGS[tag] + " ")
            elif tag in BLOCKS:
                w.block_break()
                if tag == "li":
                    w.put("- ")
            elif tag == "br":
                w.pending = False
                w.put("\n")
                continue
            stack.append((node, False))
            stack.extend((c, True) for c in reversed(node.children))
        elif tag in HEADINGS or tag in BLOCKS:
            w.block_break()
        elif tag in ("td", "th"):
            w.pending = False
            w.put(" | ")
    return w.finished()


def to_markdown(html: str | None) -> str | None:
    return None if html is None else written(parse(html))


def walk(root: Node) -> list[Node]:
    """Nodes in document order, dropped subtrees left out."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str) or node.tag in DROPPED:
            continue
        found.append(node)
        stack.extend(reversed(node.children))
    return found


def main_content(html: str) -> tuple[str, str]:
    """(title, Markdown of the densest container), densest by text length times the share of it outside links."""
    root = parse(html)
    title = ""
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, Node):
            if node.tag == "title":
                title = " ".join("".join(c for c in node.children if isinstance(c, str)).split())
                break
            stack.extend(reversed(node.children))
    nodes = walk(root)
    aside = {id(n) for n in nodes if n.tag in ASIDE_TAGS or ASIDE_NAMES.search(f"{n.attrs.get('class') or ''} {n.attrs.get('id') or ''}")}
    lengths: dict[int, tuple[int, int]] = {}
    order: list[tuple[Node, bool]] = [(root, False)]
    post: list[Node] = []
    while order:
        node, done = order.pop()
        if done:
            post.append(node)
        elif node.tag not in DROPPED and id(node) not in aside:
            order.append((node, True))
            order.extend((c, False) for c in node.children if isinstance(c, Node))
    for node in post:
        total = linked = 0
        for c in node.children:
            if isinstance(c, str):
                total += len(c.strip())
            else:
                t, k = lengths.get(id(c), (0, 0))
                total, linked = total + t, linked + k
        lengths[id(node)] = (total, total if node.tag == "a" else linked)
    best, best_score = root, -1.0
    for node in reversed(post):
        if node.tag in CONTENT_TAGS:
            total, linked = lengths[id(node)]
            weight = 1.3 if node.tag in ("article", "main") else 1.0
            score = weight * total * (1 - linked / total) if total else 0.0
            if score > best_score * (1.0 if node.tag != "div" else 1.1):
                best, best_score = node, score
    return title, written(best, frozenset(aside))


def wins(body: str, whole: str) -> bool:
    """Whether main content is enough: 200 bytes, and a twentieth of the whole page."""
    n, m = len(body.strip().encode()), len(whole.strip().encode())
    return n >= LEAST_BYTES and n * LEAST_SHARE >= m


def extract(html: str | None) -> str | None:
    """Main content under its title if it is enough, else the whole page; null if blank."""
    if html is None:
        return None
    whole = to_markdown(html)
    title, body = main_content(html)
    if wins(body, whole):
        out = body if not title or body.startswith("#") else f"# {title}\n\n{body}"
    else:
        out = whole
    return out if out.strip() else None


def _mapped(f: Callable[[str], str | None], page: Column, closed: bool = False) -> Column:
    """f over a column in Arrow batches; the function is made where a session exists. If closed, references need their semicolon."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return (pages.map(closed_references, na_action="ignore") if closed else pages).map(f, na_action="ignore")

    return run(page)


def markdown(page: Column, closed: bool = False) -> Column:
    return _mapped(to_markdown, page, closed)


def extracted(page: Column, closed: bool = False) -> Column:
    return _mapped(extract, page, closed)


def readable_wins(body: Column, whole: Column) -> Column:
    """The same test on columns, in bytes."""
    n, m = F.octet_length(trim_unicode(body)), F.octet_length(trim_unicode(whole))
    return (n >= LEAST_BYTES) & (n * LEAST_SHARE >= m)
