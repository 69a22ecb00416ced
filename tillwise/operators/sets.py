"""Set operations on rows and on arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def recipients(owners: Column, admins: Column) -> Column:
    """Addresses of both lists, each once, only those with an @."""
    return F.filter(F.array_distinct(F.array_union(owners, admins)), lambda a: a.contains("@"))


def missing(required: DataFrame, available: DataFrame) -> DataFrame:
    return required.subtract(available)


def missing_columns(required: list[str], available: list[str]) -> list[str]:
    return sorted(set(required) - set(available))


def common(requested: DataFrame, enabled: DataFrame) -> DataFrame:
    return requested.intersect(enabled)


def branches(own: Column, allowed: Column) -> Column:
    """Own branch first, then the allowed ones, without repeats."""
    return F.array_union(F.array_compact(F.array(own)), F.coalesce(allowed, F.array().cast("array<int>")))
