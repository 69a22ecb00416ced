"""Named user functions: Column functions, pandas UDFs and Arrow table functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tillwise.functions import checks, pii, transforms

RULE_CHECKS: dict[str, Callable[[], Column]] = {}


def rule_check(name: str):
    """Register a check of rule settings: an array of messages (null where fine)
    over the columns of a rule table."""

    def wrap(fn):
        RULE_CHECKS[name] = fn
        return fn

    return wrap


def _needs(condition: Column, message: str) -> Column:
    return F.when(~F.coalesce(condition, F.lit(False)), F.lit(message))


@rule_check("null_rate")
def _null_rate() -> Column:
    return F.array(
        _needs(F.col("target_column") != "", "null_rate needs a column"),
        _needs(F.col("threshold").between(0, 1), "null_rate threshold must be between 0 and 1"),
    )


@rule_check("range_check")
def _range() -> Column:
    return F.array(
        _needs(F.col("target_column") != "", "range_check needs a column"),
        _needs(F.col("min_value").isNotNull() | F.col("max_value").isNotNull(), "range_check needs a bound"),
    )


@rule_check("row_count")
def _row_count() -> Column:
    return F.array(_needs(F.col("threshold") >= 0, "row_count threshold must not be negative"))


def rule_problems() -> Column:
    """Messages for a row of a rule table, by its check type."""
    out = F.array().cast("array<string>")
    for kind, fn in RULE_CHECKS.items():
        out = F.when(F.col("check_type") == kind, F.array_compact(fn())).otherwise(out)
    return out


@F.pandas_udf(StringType())
def squeeze(s: pd.Series) -> pd.Series:
    """Example of a vectorized transform: runs of equal characters shortened."""
    return s.str.replace(r"(.)\1+", r"\1", regex=True)


def register_defaults() -> None:
    transforms.register("squeeze", lambda v, params: squeeze(v.cast("string")))
    transforms.register("clip", lambda v, params: F.left(v.cast("string"), F.lit(params["length"])))
    checks.register("starts_with", lambda v, p: v.cast("string").startswith(p["prefix"]))


SPANS = StructType([*(StructField(n, LongType()) for n in ("row",)), StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("value", StringType())])


@F.arrow_udtf(returnType=SPANS)
class PiiSpans:
    """Table function over a table argument ``(row, text)``: one row per span,
    made and handed over as Arrow batches."""

    def eval(self, table: pa.RecordBatch):
        rows, found = [], []
        for row, text in zip(table.column("row").to_pylist(), table.column("text").to_pylist(), strict=True):
            for kind, _, start, end, value, _ in pii.spans(text or ""):
                rows.append(row)
                found.append((kind, start, end, value))
        columns = [[f[k] for f in found] for k in range(4)]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
        yield pa.Table.from_arrays([pa.array(rows, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["row", "kind", "start", "end", "value"])
