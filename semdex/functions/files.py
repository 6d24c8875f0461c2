"""Tests of a file's bytes as columns, for files read by `spark.read.format("binaryFile")` or held in a table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semdex.operators.routing import is_extractable

SNIFF = 1024


def is_binary(path: Column, content: Column) -> Column:
    """A zero byte among the first 1,024; formats that text is extracted from do not count."""
    zero = F.instr(F.hex(F.regexp_replace(F.decode(F.substring(content, 1, SNIFF), "ISO-8859-1"), "[^\\x00]+", "a")), "00") > 0
    return ~is_extractable(path) & zero


def utf8_text(content: Column) -> Column:
    """The text of valid UTF-8 bytes; null for any others."""
    return F.try_validate_utf8(content.cast("string"))
