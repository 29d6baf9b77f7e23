"""Vector arithmetic on ARRAY<FLOAT> columns, always summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "L1", "L2", "Linf")
EPSILON = 1e-9


def _d(c: Column) -> Column:
    return c.cast("double")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: _d(x) * _d(x))))


def cosine_similarity(a: Column, b: Column) -> Column:
    return inner_product(a, b) / (norm(a) * norm(b))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Distance of two vectors; ``metric`` is one of METRICS."""
    if metric == "cosine":
        return F.lit(1.0) - cosine_similarity(a, b)
    gaps = F.zip_with(a, b, lambda x, y: F.abs(_d(x) - _d(y)))
    if metric == "L1":
        return _sum(gaps)
    if metric == "L2":
        return F.sqrt(_sum(F.transform(gaps, lambda x: x * x)))
    if metric == "Linf":
        return F.array_max(gaps)
    raise ValueError(f"unsupported distance metric {metric!r}; supported: {METRICS}")


def normalize_l2(a: Column) -> Column:
    """Scale to length 1 (a zero vector stays zero).

    The length is bound by a lambda of its own, else it would be computed anew for every element.
    """
    return F.transform(F.array(norm(a) + EPSILON), lambda n: F.transform(a, lambda x: _d(x) / n))[0]


def to_float_vector(a: Column, dim: int | None = None) -> Column:
    """Cast to ARRAY<FLOAT>; with ``dim``, another length becomes NULL."""
    v = a.cast("array<float>")
    return v if dim is None else F.when(F.size(v) == dim, v)
