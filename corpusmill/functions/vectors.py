"""Functions on vectors held as arrays, as Columns of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """X13 for one pair: inner product."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def similarity(a: Column, b: Column, worst: float | Column = -1.0) -> Column:
    """Inner product scaled so that `worst` is 0 and 1 is 1."""
    w = worst if isinstance(worst, Column) else F.lit(worst)
    return (dot(a, b) - w) / (1 - w)


def mean_vector(v: Column, dim: int) -> Column:
    """A12 as an aggregate: the mean of each of `dim` places, partial sums on the map side."""
    return F.array(*[F.avg(F.get(v, F.lit(i)).cast("double")) for i in range(dim)])


def sum_vector(v: Column, dim: int) -> Column:
    return F.array(*[F.sum(F.get(v, F.lit(i)).cast("double")) for i in range(dim)])
