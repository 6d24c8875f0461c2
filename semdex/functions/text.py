"""String functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_unicode(c: Column) -> Column:
    """Trim white space of any kind (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def trim_ascii(c: Column) -> Column:
    """Trim spaces, tabs, line feeds and carriage returns, and no other white space."""
    return F.btrim(c, F.lit(" \n\t\r"))


def extension(path: Column) -> Column:
    """Lower-case extension of a path's last component, empty if it has none or only a leading dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def path_contains(path: Column, part: str | None) -> Column:
    """Whether a path contains part; % and _ match as in LIKE, anything else is literal. An empty part matches all."""
    if not part:
        return F.lit(True)
    return path.like("%" + part.replace("\\", "\\\\") + "%")


def tokens(text: Column) -> Column:
    """White-space tokens; none in a blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("bigint")


def truncate_utf8(text: Column, max_bytes: int) -> Column:
    """The longest prefix of at most max_bytes UTF-8 bytes that splits no character.

    The byte after the cut tells: if it continues a character, the cut moves back to that character's first byte.
    """
    raw = F.encode(text, "UTF-8")
    cut = F.lit(max_bytes)
    for back in range(3, -1, -1):
        after = F.conv(F.hex(F.substring(raw, max_bytes + 1 - back, 1)), 16, 10).cast("int")
        cut = F.when((after < 128) | (after >= 192), F.lit(max_bytes - back)).otherwise(cut)
    short = F.octet_length(text) <= max_bytes
    return F.when(short, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def human_size(n: Column) -> Column:
    """From 1 MiB on in MB, from 1 KiB on in KB, one decimal each (halves to even); else bytes."""
    return (
        F.when(n >= 1 << 20, F.format_string("%.1f MB", F.bround(n / (1 << 20), 1)))
        .when(n >= 1 << 10, F.format_string("%.1f KB", F.bround(n / (1 << 10), 1)))
        .otherwise(F.concat(n.cast("string"), F.lit(" bytes")))
    )


def embedded_text(context: Column, content: Column) -> Column:
    """What is embedded for a chunk: its context line, if it has one, before its content."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat_ws("\n", context, content)).otherwise(content)


def chunk_id(path: Column, index: Column, content: Column) -> Column:
    """An id that retries and reruns repeat."""
    return F.sha2(F.concat_ws("\x1f", path, index.cast("string"), content), 256)
