"""Windows, rankings, paging and sampling.

Top-k filters use ``row_number() <= k`` with a literal k, which Spark turns
into a group limit before the shuffle: no key ships more than k rows per task.
Windows over raw rows of one key go through ``functions.prefix``; windows over
pre-aggregated series are bounded by the calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions import prefix
from tillwise.functions.columns import dbl, percent


def latest_per_key(df, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key; ``max_by`` reduces before the shuffle."""
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(row, F.struct(*order)).alias("_r")
    ).select("_r.*")


def top_per_key(df, keys: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def success_rate_last_n(runs, n: int) -> DataFrame:
    last = top_per_key(runs, ["rule_id"], [F.desc("finished_at"), F.desc("run_id")], n)
    return last.groupBy("rule_id").agg(
        F.count("*").alias("runs"),
        percent(F.count_if(F.col("status") == "SUCCESS"), F.count("*")).alias("success_rate"),
    )


def global_rank(df, value: str) -> DataFrame:
    """rank and dense_rank of every row, largest first and nulls last, without a
    one-task window: rows are counted per value, and the counts are added up in
    chunks of about equal size along the order."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    # Largest first is the reverse of the chunked order, so ranks count from the other end.
    ahead = prefix.running(counts, [], [value], {"_up": F.col("_n")}, row_number="_place")
    rows, values = counts.agg(F.sum("_n"), F.count("*")).first()
    ranks = ahead.select(
        F.col(value).alias("_value"),
        (F.lit(rows or 0) - F.col("_up") + 1).alias("rank"),
        (F.lit(values) - F.col("_place") + 1).alias("dense_rank"),
    )
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")


def brute_force(events, minutes=15, threshold=5, actions=("LOGIN_FAILED", "MFA_FAILED")) -> DataFrame:
    failed = events.where(F.col("action").isin(*actions) & ~F.col("success") & F.col("ip").isNotNull())
    counted = prefix.trailing_count(failed, ["ip"], "ts", "event_id", minutes * 60, "failed_attempts")
    return counted.where(F.col("failed_attempts") >= threshold)


def moving_average(series, keys: list[str], order: str, value: str, window: int, name="moving_avg") -> DataFrame:
    """Centred frame of ``window`` rows, clipped at the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window // 2), math.ceil(window / 2) - 1)
    return series.withColumn(name, dbl(F.sum(value).over(w)) / F.count(value).over(w))


def rolling_mean_diff(series, keys: list[str], order: str, value: str, window: int) -> DataFrame:
    """Trailing mean (null until the frame is full) and its first difference."""
    w = Window.partitionBy(*keys).orderBy(order)
    frame = w.rowsBetween(-(window - 1), 0)
    mean = F.when(F.count(value).over(frame) == window, dbl(F.sum(value).over(frame)) / window)
    return series.withColumn("rolling_mean", mean).withColumn(
        "rolling_diff", F.col("rolling_mean") - F.lag("rolling_mean").over(w)
    )


def local_peaks(series, keys: list[str], order: str, value: str, height: Column) -> DataFrame:
    """Rows whose value is above both neighbours and at least ``height``."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = series.withColumns({"_a": F.lag(value).over(w), "_b": F.lead(value).over(w)})
    return marked.where((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")) & (F.col(value) >= height)).drop("_a", "_b")


def period_change(series, keys: list[str], order: str, value: str) -> DataFrame:
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return series.withColumn("previous", prev).withColumn(
        "change", F.when(F.col("previous") != 0, dbl(F.col(value) - F.col("previous")) * 100 / dbl("previous"))
    )


def share_of_total(df, group: list[str], value: str) -> DataFrame:
    return df.withColumn("share", percent(value, F.sum(value).over(Window.partitionBy(*group))))


def sort_multi(df, ordering: list[str], allowed: list[str], default: list[str]) -> DataFrame:
    """``-name`` is descending; names outside the whitelist are ignored."""
    wanted = [o for o in ordering if o.lstrip("-") in allowed] or default
    return df.orderBy(*[F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in wanted])


# Default and largest page sizes of the list views.
PAGE_SIZES = {"standard": (25, 100), "large": (50, 500), "dq": (50, 1000)}


def page(df, order: list[Column], number: int = 1, size: int | None = None, kind: str = "standard") -> DataFrame:
    """One page; the order must end in a unique key."""
    default, largest = PAGE_SIZES[kind]
    n = min(size or default, largest)
    return df.orderBy(*order).offset((number - 1) * n).limit(n)


def top_with_other(df, label: str, value: str, n: int) -> DataFrame:
    """First n labels and one 'Other' row with the sum and number of the rest.
    ``df`` has one row per label."""
    best = df.orderBy(F.desc(value), label).limit(n)
    kept = best.select(F.col(label).alias("_label"))
    rest = df.join(kept, F.col(label).eqNullSafe(F.col("_label")), "left_anti").agg(
        F.sum(value).alias(value), F.count("*").alias("grouped")
    )
    other = rest.where(F.col(value) > 0).select(F.lit("Other").alias(label), value, "grouped")
    return best.select(label, value, F.lit(0).cast("long").alias("grouped")).unionByName(other)


def sample_rows(df, key: Column, buckets: int, keep: int) -> DataFrame:
    """Deterministic sample: rows whose key digest falls in the first ``keep``
    of ``buckets`` buckets."""
    digest = F.conv(F.left(F.md5(key.cast("string")), F.lit(8)), 16, 10).cast("long")
    return df.where(digest % buckets < keep)
