"""Vector functions as Spark columns, in double arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from semdex.functions.binding import let


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return let(doubles(a), lambda x: let(doubles(b), lambda y: F.try_divide(dot(x, y), norm(x) * norm(y))))


def literal(v: Sequence[float]) -> Column:
    """A vector as one literal, folded before the scan starts; as text, so that the JVM builds it in one call."""
    numbers = [repr(x) + "D" if math.isfinite(x) else f"double('{x}')" for x in map(float, v)]
    return F.expr(f"array({', '.join(numbers)})") if numbers else F.array().cast("array<double>")


def cosine_to(v: Column, query: Sequence[float]) -> Column:
    """Cosine similarity to one query vector, whose norm is computed once on the driver."""
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return let(doubles(v), lambda x: F.try_divide(dot(x, literal(query)), norm(x) * length))


def comparable(score: Column) -> Column:
    """The score, null where it is NaN, which Spark would rank above all numbers."""
    return F.nanvl(score, F.lit(None).cast("double"))


def passes(score: Column, least: float) -> Column:
    """score >= least; null and NaN scores do not pass (in Spark NaN is larger than any number)."""
    return F.coalesce(~F.isnan(score) & (score >= least), F.lit(False))
