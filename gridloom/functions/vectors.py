"""Vector expressions over ``ARRAY`` columns (JVM-side higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda p: p.cast("double") * p.cast("double"))))


def squared_distance(a: Column, b: Column) -> Column:
    def term(p, q):
        d = p.cast("double") - q.cast("double")
        return d * d

    return _sum(F.zip_with(a, b, term))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine similarity; each norm is floored at ``eps``."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def l2_normalize(a: Column, eps: float = 1e-8) -> Column:
    """Divide by the norm, floored at ``eps``.  The norm is evaluated once per row."""
    return F.transform(
        F.array(F.struct(a.alias("v"), F.greatest(norm(a), F.lit(eps)).alias("n"))),
        lambda s: F.transform(s["v"], lambda p: p.cast("double") / s["n"]),
    )[0]


def sinusoidal(value: Column, dim: int, max_period: float = 10000.0) -> Column:
    """``[cos(v * f_i)] ++ [sin(v * f_i)]`` with ``f_i = exp(-ln(max_period) * i / half)``."""
    half = dim // 2
    freqs = [F.exp(F.lit(-1.0) * F.log(F.lit(max_period)) * F.lit(i) / F.lit(half)) for i in range(half)]
    return F.array(*[F.cos(value * f) for f in freqs], *[F.sin(value * f) for f in freqs])
