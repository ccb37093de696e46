"""Vector expressions over ``array<float>`` / ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _same_width(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.size(a) > 0)


def _finite(col: Column) -> Column:
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))), col)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def unit(a: Column) -> Column:
    """``a`` scaled to length one; null elements for a zero vector."""
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), l2_norm(a)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, or null if a side is null or empty, widths differ, or the result is not finite."""
    return F.when(_same_width(a, b), _finite(F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))))


def neg_manhattan(a: Column, b: Column) -> Column:
    """Minus the L1 distance: a similarity that is 0 for equal vectors."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.when(_same_width(a, b), -_sum(gaps))
