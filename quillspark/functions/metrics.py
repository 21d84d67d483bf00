"""Retrieval metrics on arrays: retrieved (best first) and relevant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hit(retrieved: Column, relevant: Column, k: int) -> Column:
    return F.when(F.arrays_overlap(F.slice(retrieved, 1, k), relevant), 1.0).otherwise(0.0)


def recall(retrieved: Column, relevant: Column, k: int) -> Column:
    found = F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)).cast("double")
    return F.when(F.size(relevant) > 0, found / F.size(relevant)).otherwise(0.0)


def first_hit_rank(retrieved: Column, relevant: Column) -> Column:
    at = F.filter(F.transform(relevant, lambda r: F.array_position(retrieved, r)), lambda p: p > 0)
    return F.array_min(at)


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    return F.coalesce(F.lit(1.0) / first_hit_rank(retrieved, relevant), F.lit(0.0))


def missed(retrieved: Column, relevant: Column) -> Column:
    return F.filter(relevant, lambda r: ~F.array_contains(retrieved, r))


def decision_precision(got: Column, want: Column) -> Column:
    both = F.size(F.array_intersect(got, want)).cast("double")
    return F.when(F.size(got) > 0, both / F.size(F.array_distinct(got))).when(F.size(want) == 0, 1.0).otherwise(0.0)


def decision_recall(got: Column, want: Column) -> Column:
    both = F.size(F.array_intersect(got, want)).cast("double")
    return F.when(F.size(want) > 0, both / F.size(F.array_distinct(want))).otherwise(1.0)


def exact(got: Column, want: Column) -> Column:
    return F.array_sort(F.array_distinct(got)) == F.array_sort(F.array_distinct(want))
