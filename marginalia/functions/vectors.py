"""Vector expressions on array<double> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector counts as length 1, so the result is 0."""
    length = lambda v: F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return dot(a, b) / (length(a) * length(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(distance, F.lit(0.0)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, which is computed once a row: inside a lambda an expression runs for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hash_vector(text: Column, dimension: int = 16) -> Column:
    """Deterministic unit vector: bytes of SHA-256 of ``counter:text`` over 255, cut to the dimension."""
    digests = [F.sha2(F.concat(F.lit(f"{i}:"), text), 256) for i in range((dimension + 31) // 32)]
    places = F.sequence(F.lit(0), F.lit(dimension - 1))
    raw = bound(F.concat(*digests), lambda h: F.transform(places, lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255))
    return bound(raw, lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))))
