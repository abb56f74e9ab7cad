"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column, width: int | None = None) -> Column:
    """The product of two arrays; with their ``width`` it is written out, which Spark can compile."""
    if width is not None:
        return sum((F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(width)), F.lit(0.0))
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def is_unit(a: Column, size: int, within: float = 1e-4) -> Column:
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == size) & finite & (F.abs(norm(a) - 1) <= within), F.lit(False))
