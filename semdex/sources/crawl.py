"""Crawling a file tree and reading its files.

The driver lists small trees; of larger ones it lists the upper folders, and executors walk below them. Bytes are read where
the tasks run, so the tree must be on storage that all of them see. Ignore rules come from .gitignore and .semdexignore files of every folder, hidden names are passed over, and
the configured patterns apply from the root.
"""

from __future__ import annotations

import itertools
import os
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex.config import PROJECT_DIR, Indexing
from semdex.operators.routing import EXTRACTABLE, is_extractable
from semdex.schema import FILES, TEXTS
from semdex.sources import documents, html, pdf

IGNORE_FILES = (".gitignore", ".semdexignore")
SNIFF = 1024


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file, relative to the folder it lies in."""

    pattern: re.Pattern
    folder_only: bool
    negated: bool

    @classmethod
    def parse(cls, line: str) -> Rule | None:
        line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
        if not line or line.startswith("#"):
            return None
        negated = line.startswith("!")
        line = line[1:] if negated else line
        line = line[1:] if line.startswith(("\\#", "\\!")) else line
        folder_only = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        return cls(re.compile(("" if anchored else "(?:.*/)?") + glob_regex(line.lstrip("/")) + r"\Z", re.S), folder_only, negated)


def glob_regex(glob: str) -> str:
    """* and ? stay within a component, ** spans components, [..] is a class."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        elif glob[k] == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            inner = glob[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inner[1:] if inner[:1] in ("!", "^") else inner) + "]", end + 1
        elif glob[k] == "\\" and k + 1 < len(glob):
            out, k = out + re.escape(glob[k + 1]), k + 2
        else:
            out, k = out + re.escape(glob[k]), k + 1
    return out


def rules_of(path: Path) -> list[Rule]:
    try:
        return [r for line in path.read_text("utf-8", "replace").splitlines() if (r := Rule.parse(line))]
    except OSError:
        return []


def _fixed(config: Indexing) -> list[Rule]:
    return [r for p in config.ignore_patterns if (r := Rule.parse(p))]


def walk(root: str | Path, config: Indexing, start: str = "") -> Iterator[tuple[str, list[str], list[str]]]:
    """(folder, its folders, its files) from a folder of the tree downwards, without what a rule ignores.

    start and the folders given are relative to root and end with a slash; rules of the folders above start hold as well.
    """
    fixed, inherited = _fixed(config), {}
    if start:
        above = [start[: k + 1] for k, c in enumerate(start[:-1]) if c == "/"]
        inherited[os.path.dirname(start[:-1])] = [(base, own) for base in ["", *above] if (own := own_rules(Path(root, base)))]

    def ignored(rel: str, folder: bool, levels: list[tuple[str, list[Rule]]]) -> bool:
        if any(r.pattern.match(rel) and (folder or not r.folder_only) for r in fixed):
            return True
        verdict = False
        for base, rules in levels:
            inner = rel[len(base) :]
            for r in rules:
                if r.pattern.match(inner) and (folder or not r.folder_only):
                    verdict = not r.negated
        return verdict

    for folder, names, files in os.walk(Path(root, start), followlinks=config.follow_symlinks, onerror=lambda e: warnings.warn(str(e), stacklevel=2)):
        rel = os.path.relpath(folder, root)
        base = "" if rel == "." else rel.replace(os.sep, "/") + "/"
        own = own_rules(Path(folder))
        levels = inherited.get(os.path.dirname(base[:-1]) if base else "", []) + ([(base, own)] if own else [])
        inherited[base[:-1]] = levels
        names[:] = sorted(n for n in names if not n.startswith(".") and not ignored(base + n, True, levels))
        yield base, names, sorted(n for n in files if not n.startswith(".") and not ignored(base + n, False, levels))


def own_rules(folder: Path) -> list[Rule]:
    return [r for name in IGNORE_FILES for r in rules_of(folder / name)]


def entry_of(path: str, config: Indexing) -> tuple[str, int, int] | None:
    """(path, modification time in ns, size) of a file; None for what is none, is binary or cannot be read, the last with a warning."""
    try:
        if not os.path.isfile(path) or (os.path.islink(path) and not config.follow_symlinks):
            return None
        stat = os.stat(path)
        return None if config.skip_binary and is_binary(path) else (path, stat.st_mtime_ns, stat.st_size)
    except OSError as e:
        warnings.warn(f"skipping {path}: {e}", stacklevel=2)
        return None


def crawl_paths(root: str | Path, config: Indexing | None = None) -> Iterator[tuple[str, int, int]]:
    """(path, modification time in ns, size) of the files that no rule ignores; what cannot be read is warned of and passed over."""
    config = config or Indexing()
    for base, _, files in walk(root, config):
        yield from (found for name in files if (found := entry_of(os.path.join(root, base, name), config)))


def upper_folders(root: str | Path, config: Indexing, enough: int) -> list[tuple[str, bool]]:
    """Folders that together make up the tree, and whether all below belongs to one or only its own files; level by level, until
    there are enough of them."""
    alone, level = [], [""]
    while level and len(alone) + len(level) < enough:
        below = []
        for base in level:
            names = next(walk(root, config, base), (base, [], []))[1]
            # Links to folders are passed over in a walk unless links are followed.
            below += [f"{base}{n}/" for n in names if config.follow_symlinks or not Path(root, base, n).is_symlink()]
        alone += [(base, False) for base in level]
        level = below
    return alone + [(base, True) for base in level]


def is_binary(path: str) -> bool:
    """A zero byte among the first 1,024; formats that text is extracted from do not count."""
    if path.rpartition(".")[2].lower() in EXTRACTABLE:
        return False
    with open(path, "rb") as f:
        return b"\0" in f.read(SNIFF)


def crawl(spark: SparkSession, root: str | Path, config: Indexing | None = None, few: int = 10_000) -> DataFrame:
    """The files of crawl_paths(). A tree of more than a few files is walked by the executors, folder by folder, and its files are
    looked at in other tasks, so that a large folder does not keep one busy."""
    config = config or Indexing()
    found = list(itertools.islice(crawl_paths(root, config), few + 1))
    if len(found) <= few:
        return spark.createDataFrame(found, FILES)
    root, slots = str(root), spark.sparkContext.defaultParallelism
    folders = upper_folders(root, config, 4 * slots)

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, deep in zip(pdf["base"], pdf["deep"]):
                for base, _, files in walk(root, config, start) if deep else itertools.islice(walk(root, config, start), 1):
                    yield pd.DataFrame({"file_path": [os.path.join(root, base, n) for n in files]}, dtype=object)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([e for p in pdf["file_path"] if (e := entry_of(p, config))], columns=FILES.names)

    dealt = spark.createDataFrame(folders, "base string, deep boolean").repartition(min(len(folders), 4 * slots))
    return dealt.mapInPandas(names, "file_path string").repartition(4 * slots, "file_path").mapInPandas(entries, FILES)


def text_of(path: str, raw: bytes) -> tuple[str | None, str | None]:
    """(text, None), or (None, what kept it from being read)."""
    ext = path.rpartition(".")[2].lower()
    if ext in ("html", "htm", "xhtml"):
        out = html.extract(raw.decode("utf-8", "replace"))
    elif ext == "docx":
        out = documents.docx_text(raw)
    elif ext == "pdf":
        out = pdf.pdf_text(raw)
    else:
        try:
            return raw.decode("utf-8"), None
        except UnicodeDecodeError:
            return None, "not UTF-8"
    return (out, None) if out is not None else (None, "no text")


def read_texts(files: DataFrame, max_file_size_mb: int = 10) -> DataFrame:
    """The text of each file; the size bound holds for formats that need extraction."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path, too_big in zip(pdf["file_path"], pdf["too_big"]):
                if too_big:
                    found.append((None, "too large"))
                    continue
                try:
                    with open(path, "rb") as f:
                        found.append(text_of(path, f.read()))
                except OSError as e:
                    found.append((None, str(e)))
            yield pdf[FILES.names].assign(text=[t for t, _ in found], problem=[p for _, p in found])

    too_big = is_extractable(F.col("file_path")) & (F.col("size") > max_file_size_mb << 20)
    return files.select(*FILES.names, too_big.alias("too_big")).mapInPandas(read, TEXTS)


def find_index_root(start: str | Path) -> Path | None:
    """The nearest folder upwards that holds an index."""
    start = Path(start).absolute()
    return next((p for p in [start, *start.parents] if (p / PROJECT_DIR).is_dir()), None)
