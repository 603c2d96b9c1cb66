"""Vector expressions on arrays, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if an array is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def finite(a: Column) -> Column:
    """The array in double precision with NaN and infinite elements as 0."""
    return F.transform(a, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), F.lit(0.0)).otherwise(x.cast("double")))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once, not once for each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def l2_normalize(a: Column) -> Column:
    """The array divided by its length; zeros where the length is at most 1e-12."""
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n > 1e-12, x.cast("double") / n).otherwise(0.0))
    return let(a, lambda v: let(F.sqrt(dot(v, v)), lambda n: scaled(v, n)))


def mix(a: Column, b: Column, alpha: float) -> Column:
    """alpha * a + (1 - alpha) * b, normalised; a alone where b is null."""
    both = F.zip_with(a, b, lambda x, y: F.lit(alpha) * x + F.lit(1.0 - alpha) * y)
    return F.when(b.isNull(), l2_normalize(a)).otherwise(l2_normalize(both))
