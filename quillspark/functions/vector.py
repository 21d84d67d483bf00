"""Vector expressions on ``array<float|double>`` columns; all arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length; 0.0 for an empty vector. Components that are null or no number count as nothing."""
    n = F.least(F.size(a), F.size(b))
    terms = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(F.nanvl(x.cast("double") * x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def cosine(a: Column, b: Column) -> Column:
    """0.0 if either norm is 0. Norms are over the whole vectors, the product over the shorter length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def as_vector(text: Column) -> Column:
    """``"[0.1,-2]"`` to ``array<double>``; null and blank text give an empty array."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, r"[\[\]]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.transform(parts, lambda x: x.cast("double")), F.array().cast("array<double>"))
