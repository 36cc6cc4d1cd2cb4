"""Distances and scores as Column expressions; float elements are computed as doubles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, InvalidConfig

#: Wire names of the metrics.
METRICS = ("l2", "cosine", "dot_product")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise InvalidConfig(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    return metric


def vector(values: Sequence[float] | Column) -> Column:
    """A literal query vector, or the column as it is."""
    return values if isinstance(values, Column) else F.array(*[F.lit(float(x)) for x in values])


def _double(x: Column) -> Column:
    return x.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def dot_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; exactly 1 if either norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / F.when(size == 0, F.lit(1.0)).otherwise(size))


def distance(metric: str, a: Column, b: Column) -> Column:
    """The true distance of two vectors; null if their sizes differ raises at run time."""
    found = {"l2": l2, "cosine": cosine_distance, "dot_product": dot_distance}[check_metric(metric)](a, b)
    return F.when(F.size(a) == F.size(b), found).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("double"))


def ordering_distance(metric: str, a: Column, b: Column) -> Column:
    """In the order of the true distance, without the square root."""
    return l2_squared(a, b) if check_metric(metric) == "l2" else distance(metric, a, b)


def true_distance(metric: str, ordering: Column) -> Column:
    return F.sqrt(ordering) if check_metric(metric) == "l2" else ordering


def query_distance(metric: str, vec: Column, query: Sequence[float]) -> Column:
    """The ordering distance to a fixed query, whose norm is computed once here."""
    q = vector(query)
    if check_metric(metric) == "l2":
        return l2_squared(vec, q)
    if metric == "dot_product":
        return dot_distance(vec, q)
    own = math.sqrt(sum(float(x) * float(x) for x in query))
    if own == 0:
        return F.lit(1.0)
    size = norm(vec)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(vec, q) / (F.when(size == 0, F.lit(1.0)).otherwise(size) * F.lit(own)))


def normalize(a: Column) -> Column:
    """To unit length; a zero vector stays."""
    size = norm(a)
    return F.when(size == 0, _double(a)).otherwise(F.transform(_double(a), lambda x: x / F.when(size == 0, F.lit(1.0)).otherwise(size)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def binary_distance(metric: str, differing: Column, dims: int | Column, norm_a: Column, norm_b: Column) -> Column:
    """The distance that a sign pattern stands for: a share of bits, or an estimated negative dot product."""
    dims = F.lit(dims) if isinstance(dims, int) else dims
    if check_metric(metric) == "dot_product":
        return -((dims - 2 * differing) * norm_a * norm_b / dims)
    return differing / dims


def check_dimensions(query: Sequence[float], dimensions: int) -> None:
    if len(query) != dimensions:
        raise DimensionMismatch(f"expected {dimensions} dimensions, got {len(query)}")


def register(spark: SparkSession) -> None:
    """vec_dot, vec_l2, vec_l2_squared, vec_cosine_distance, vec_dot_distance and vec_norm for SQL."""
    two = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
    dot_ = "aggregate(zip_with({}, {}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    square = "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"
    size = f"(sqrt({dot_.format('a', 'a')}) * sqrt({dot_.format('b', 'b')}))"
    for name, args, body in (
        ("vec_dot", two, dot_.format("a", "b")),
        ("vec_l2_squared", two, square),
        ("vec_l2", two, f"sqrt({square})"),
        ("vec_dot_distance", two, f"-{dot_.format('a', 'b')}"),
        ("vec_cosine_distance", two, f"coalesce(1D - try_divide({dot_.format('a', 'b')}, {size}), 1D)"),
        ("vec_norm", "a ARRAY<DOUBLE>", f"sqrt({dot_.format('a', 'a')})"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
