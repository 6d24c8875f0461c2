"""Binding a value to a lambda variable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, wherever the optimizer moves or copies the expression.

    Lambdas over an expression evaluate it anew for each element; over a lambda variable they do not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
