"""Vector expressions over ARRAY<FLOAT> or ARRAY<DOUBLE> columns; arithmetic is in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A vector shorter than this keeps its (near) zeros instead of being blown up.
EPSILON = 1e-12
#: Digits to which similarities are rounded before they are ranked or compared for equality.
DIGITS = 9


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda total, x: total + x * x))


def l2_normalize(v: Column) -> Column:
    """v / max(|v|, 1e-12); a zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(EPSILON))
    return F.transform(as_double(v), lambda x: x / length)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def similarity(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, rounded so that equal scores are equal on every engine."""
    return F.round(dot(a, b), DIGITS)
