"""Routing of files by extension: kind of text, code language, document formats that need extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semdex.functions.text import extension

# The extensions of each kind.
CODE = (
    "rs py js ts tsx jsx go c cpp h hpp java rb sh bash zsh swift kt scala php cs lua r pl pm ex exs erl hs ml vue svelte zig nim v d "
    "f90 jl clj lisp el vim sql graphql proto thrift"
).split()
MARKDOWN = "md mdx markdown html htm xhtml docx".split()
PROSE = "pdf txt rst adoc asciidoc org tex".split()
EXTRACTABLE = "html htm xhtml pdf docx".split()
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go"}


def file_type(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin(CODE), F.lit("code"))
        .when(ext.isin(MARKDOWN), F.lit("markdown"))
        .when(ext.isin(PROSE), F.lit("prose"))
        .otherwise(F.lit("unknown"))
    )


def language(path: Column) -> Column:
    """Language of the syntax chunkers; null for others."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, F.lit(name)).otherwise(out)
    return out


def is_extractable(path: Column) -> Column:
    return extension(path).isin(EXTRACTABLE)
