"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: str | Column) -> Column:
    return col(c).cast("double")


def ratio(num: str | Column, den: str | Column, when_zero=None) -> Column:
    """Double division; ``when_zero`` where the denominator is zero or null."""
    d = dbl(den)
    return F.when(d != 0, dbl(num) / d).otherwise(F.lit(when_zero).cast("double"))


def percent(num: str | Column, den: str | Column, when_zero=None) -> Column:
    d = dbl(den)
    return F.when(d != 0, dbl(num) * 100 / d).otherwise(F.lit(when_zero).cast("double"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def text(c: str | Column) -> Column:
    return col(c).cast("string")
