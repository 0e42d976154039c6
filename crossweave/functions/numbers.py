"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(x: Column, digits: int) -> Column:
    """Rounds the exact binary value, halves to even, as a reader of a double's decimal digits expects."""
    return F.bround(x.cast("decimal(38,18)"), digits).cast("double")


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product in double precision, from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))
