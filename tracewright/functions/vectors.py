"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def truncate_normalise(v: Column, dims: int) -> Column:
    """The first dims components at length 1; a shorter vector is an error."""
    return F.when(F.size(v) < dims, F.raise_error(F.lit(f"a vector has fewer than {dims} components"))).otherwise(normalise(F.slice(v, 1, dims)))
