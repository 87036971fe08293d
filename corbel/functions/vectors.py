"""Column functions over ``array<float>`` vectors, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / scale)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: (x.cast("double") / n).cast("float")))


def usable(a: Column, dim: int) -> Column:
    """Exactly ``dim`` finite numbers, not all zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return a.isNotNull() & (F.size(a) == dim) & finite & F.exists(a, lambda x: x != 0)


def checked(a: Column, dim: int) -> Column:
    """``a`` itself; a vector of another width stops the query (null passes)."""
    bad = a.isNotNull() & (F.size(a) != dim)
    return F.when(bad, F.raise_error(F.concat(F.lit(f"vector must have {dim} dimensions, not "), F.size(a).cast("string")))).otherwise(a)
