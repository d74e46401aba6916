"""Distances of vectors as expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.plans.parser import GqlError


def _sum(a: Column, b: Column, f) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; a zero norm is an error."""
    size = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return F.when(size == 0, F.raise_error(F.lit("22023: cosine of a zero vector")).cast("double")).otherwise(1 - inner_product(a, b) / size)


#: Names of metrics.
METRICS = {
    "l2": squared_euclidean, "euclidean": squared_euclidean, "squared_euclidean": squared_euclidean,
    "cosine": cosine_distance, "cos": cosine_distance,
    "ip": negative_inner_product, "dot": negative_inner_product, "inner_product": negative_inner_product, "negative_inner_product": negative_inner_product,
}


def metric(name: str | None):
    try:
        return METRICS[(name or "cosine").lower()]
    except KeyError:
        raise GqlError(f"unknown metric {name}", "22023") from None


FUNCTIONS = {"VECTOR_COSINE_DISTANCE": cosine_distance, "VECTOR_SQUARED_EUCLIDEAN": squared_euclidean, "VECTOR_INNER_PRODUCT": inner_product}
