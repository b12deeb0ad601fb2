"""Vector expressions over array<double> columns. They stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null where a vector is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column | str, floor: float = 1e-8) -> Column:
    """The vector over its length; lengths below the floor count as the floor."""
    length = F.greatest(norm(v), F.lit(floor))
    # The length is computed once, as the argument of an outer transform.
    return F.flatten(F.transform(F.array(length), lambda n: F.transform(v, lambda x: x / n)))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def power_normalized(v: Column | str, alpha: float = 0.5) -> Column:
    """sign(x) * |x|**alpha for each component, then unit length."""
    return normalized(F.transform(v, lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(alpha))))


def blended(parts: list[tuple[Column, float]]) -> Column:
    """The weighted sum of vectors."""
    (first, weight), *rest = parts
    out = F.transform(first, lambda x: x * weight)
    for v, w in rest:
        out = _plus(out, v, w)
    return out


def _plus(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * weight)
