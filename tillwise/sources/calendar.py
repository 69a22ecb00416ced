"""Generated dimensions and time axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dim_date(days: DataFrame, fiscal_start_month: int = 1) -> DataFrame:
    """Calendar columns for a frame with one ``date`` per row."""
    d = F.col("date")
    fiscal = F.add_months(d, (13 - fiscal_start_month) % 12)
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"),
        d.alias("date"),
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.dayofmonth(d).alias("day"),
        (F.dayofweek(d) - 1).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.weekofyear(d).alias("week_of_year"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
        F.year(fiscal).alias("fiscal_year"),
        F.quarter(fiscal).alias("fiscal_quarter"),
    )


def date_axis(spark: SparkSession, start: str = "2020-01-01", end: str = "2030-12-31") -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date")
    )


def axis_of(df: DataFrame, ts: str, interval: str) -> DataFrame:
    """Every hour, day, week or month between the first and the last time."""
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}[interval]
    bounds = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    trunc = "day" if interval == "week" else interval
    return bounds.select(
        F.explode(F.sequence(F.date_trunc(trunc, "a"), F.col("b").cast("timestamp"), F.expr(step))).alias("t")
    )


def shift_of(hour: Column) -> Column:
    """First match wins: hour 14 is Morning, hour 22 is Evening."""
    return F.when(hour.between(6, 14), "Morning").when(hour.between(14, 22), "Evening").otherwise("Night")


def dim_time(spark: SparkSession) -> DataFrame:
    """1440 one-minute rows."""
    m = F.col("id")
    h, minute = F.floor(m / 60).cast("int"), (m % 60).cast("int")
    twelve = F.when(h % 12 == 0, 12).otherwise(h % 12)
    return spark.range(1440).select(
        (h * 100 + minute).alias("time_key"),
        h.alias("hour"),
        minute.alias("minute"),
        F.lit(0).alias("second"),
        twelve.alias("hour_12"),
        F.when(h < 12, "AM").otherwise("PM").alias("am_pm"),
        F.format_string("%02d:%02d", h, minute).alias("time_name"),
        shift_of(h).alias("shift"),
    )
