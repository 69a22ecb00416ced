"""Time series: buckets, downsampling, outliers, gaps, cohorts, metric queries."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType

from tillwise.functions import prefix
from tillwise.functions.columns import dbl, ratio
from tillwise.functions.times import sunday_week
from tillwise.session import checkpointed


def bucket_of(ts: str, interval: str) -> Column:
    """Start of the hour, day, week (from Sunday) or month."""
    if interval == "week":
        return sunday_week(F.col(ts)).cast("timestamp")
    if interval not in ("hour", "day", "month"):
        raise ValueError(f"unknown interval {interval}")
    return F.date_trunc(interval, ts)


AGGREGATES = {
    "sum": lambda v, o: dbl(F.sum(v)),
    "avg": lambda v, o: ratio(F.sum(v), F.count(v)),
    "max": lambda v, o: dbl(F.max(v)),
    "min": lambda v, o: dbl(F.min(v)),
    "count": lambda v, o: F.count(v),
    "first": lambda v, o: dbl(F.min_by(v, o)),
}


def bucket_agg(df: DataFrame, ts: str, value: str, order: Column, interval: str, how=("sum", "count"), keys=()) -> DataFrame:
    return df.groupBy(*keys, bucket_of(ts, interval).alias("bucket")).agg(
        *[AGGREGATES[h](F.col(value), order).alias(h) for h in how], F.count("*").alias("n")
    )


def bucket_aggs(df: DataFrame, ts: str, value: str, order: Column, intervals, how=("sum", "count"), keys=()) -> DataFrame:
    """``bucket_agg`` at several intervals (column ``step``) in one pass."""
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), bucket_of(ts, i).alias("bucket")) for i in intervals]))
    return df.withColumn("_place", places).groupBy("_place.step", *keys, "_place.bucket").agg(
        *[AGGREGATES[h](F.col(value), order).alias(h) for h in how], F.count("*").alias("n")
    )


def fill_gaps(series: DataFrame, axis: DataFrame, keys: DataFrame, on: str, fills: dict[str, float]) -> DataFrame:
    """Every axis point for every key. Keys and axis are both short (labels and
    calendar steps); the axis is exploded from an array, not cross joined."""
    steps = axis.agg(F.array_sort(F.collect_set(on)).alias("_axis")).scalar()
    full = keys.withColumn(on, F.explode(steps))
    return full.join(series, [*keys.columns, on], "left").na.fill(fills)


def outliers_iqr(df: DataFrame, value: str) -> DataFrame:
    """Rows outside 1.5 IQR; quartiles are the values at floor(n q) of the sorted column."""
    q1, q3 = prefix.values_at_ranks(df, value, [0.25, 0.75])
    if q1 is None:
        return df.limit(0)
    spread = q3 - q1
    v = dbl(value)
    return df.where((v < q1 - 1.5 * spread) | (v > q3 + 1.5 * spread))


# --- largest triangle three buckets (Steinarsson 2013) ----------------------


def _hull(i: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of the convex hull's corners (monotone chain over sorted x)."""
    order = np.lexsort((y, x))
    if len(order) <= 3:
        return order

    def chain(seq):
        out: list[int] = []
        for p in seq:
            while len(out) > 1:
                a, b = out[-2], out[-1]
                if (x[b] - x[a]) * (y[p] - y[a]) - (y[b] - y[a]) * (x[p] - x[a]) <= 0:
                    out.pop()
                else:
                    break
            out.append(p)
        return out

    return np.unique(np.array(chain(order) + chain(order[::-1])))


CORNERS = "b int, total bigint, sx double, sy double, m bigint, i array<bigint>, x array<double>, y array<double>"


def _bucket(i: np.ndarray, total: int, n: int) -> np.ndarray:
    """Bucket of each place: -1 the first point, n - 2 the last, all places if they are few."""
    if total <= n:
        return i
    inner = np.minimum(np.floor((i - 1) / ((total - 2) / float(n - 2))), n - 3).astype(np.int64)
    return np.where(i == 0, -1, np.where(i == total - 1, n - 2, inner))


def _bucket_hulls(n: int):
    """Sorted points of a chunk → per series and bucket the corners of their
    hull, their number and sums; a bucket may come in several parts."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("s").dictionary_encode()
            code = key.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            total, i, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("total", "i", "x", "y"))
            edge = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            rows, at = [], []
            for low, high in zip(edge[:-1], edge[1:], strict=True):
                b = _bucket(i[low:high], int(total[low]), n)
                inner = [low, *(low + np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), high]
                for p, q in zip(inner[:-1], inner[1:], strict=True):
                    keep = p + _hull(i[p:q], x[p:q], y[p:q])
                    rows.append((int(b[p - low]), int(total[p]), float(x[p:q].sum()), float(y[p:q].sum()), q - p, i[keep].tolist(), x[keep].tolist(), y[keep].tolist()))
                    at.append(p)
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("s").take(pa.array(at)), *columns], names=["s", "b", "total", "sx", "sy", "m", "i", "x", "y"])

    return run


def _merged_buckets(batches):
    """Parts of buckets in order → (series, total, corners' places, x, y, mean) of each bucket."""

    def whole(parts: list[dict]) -> tuple:
        i, x, y = (np.concatenate([np.asarray(p[c]) for p in parts]) for c in ("i", "x", "y"))
        keep = _hull(i, x, y)
        keep = keep[np.argsort(i[keep], kind="stable")]
        m = sum(p["m"] for p in parts)
        mean = sum(p["sx"] for p in parts) / m, sum(p["sy"] for p in parts) / m
        return parts[0]["s"], parts[0]["total"], i[keep], x[keep], y[keep], mean

    parts: list[dict] = []
    for batch in batches:
        for part in batch.to_pylist():
            if parts and (part["s"], part["b"]) != (parts[0]["s"], parts[0]["b"]):
                yield whole(parts)
                parts = []
            parts.append(part)
    if parts:
        yield whole(parts)


def _chosen(n: int, kind: pa.DataType):
    """Buckets of a series in order → its chosen points. A bucket waits for the
    mean of the next one, so two buckets are all that is kept."""

    def run(batches):
        out, before, picked = [], None, None
        for bucket in itertools.chain(_merged_buckets(batches), [None]):
            if before is not None:
                series_, total, i, x, y, _ = before
                following = bucket[5] if bucket is not None and bucket[0] == series_ else None
                k = 0
                if following is not None and picked is not None and total > n:
                    k = int(np.argmax(np.abs((picked[1] - following[0]) * (y - picked[2]) - (picked[1] - x) * (following[1] - picked[2]))))
                picked = int(i[k]), float(x[k]), float(y[k])
                out.append((series_, *picked))
                if following is None:
                    picked = None
            before = bucket
        kinds = (kind, pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kinds[c]) for c in range(4)], names=["s", "i", "x", "y"])

    return run


def lttb(points: DataFrame, series: str, x: str, y: str, n: int, tie: str) -> DataFrame:
    """Exact downsampling of every series to n points, first and last kept.

    The chosen point of a bucket maximises a triangle area, which is linear in
    the point, so it is a corner of the bucket's convex hull. Points are cut into
    chunks along series and time; a chunk makes the hulls and sums of its
    buckets in one pass, and parts of a bucket merge to the hull of their
    corners. Then a series is a row per bucket, which are gone through in order.
    Null series are one; points without x or y are left out.
    """
    base = points.select(F.col(series).alias("s"), dbl(x).alias("x"), dbl(y).alias("y"), F.col(tie).alias("t")).where("x IS NOT NULL AND y IS NOT NULL")
    parts = prefix.cut(base, ["s", "x", "t"])
    kind = dict(parts.dtypes)["s"]
    counts = parts.groupBy("s", prefix.CHUNK).agg(F.count("*").alias("c"))
    of_series = Window.partitionBy("s")
    before = of_series.orderBy(prefix.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(F.col("s").alias("s_"), F.col(prefix.CHUNK).alias("c_"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"), F.sum("c").over(of_series).alias("total"))
    inside = Window.partitionBy("s", prefix.CHUNK).orderBy("x", "t")
    placed = parts.join(places, parts["s"].eqNullSafe(places["s_"]) & (parts[prefix.CHUNK] == places["c_"]))
    ranked = placed.select("s", prefix.CHUNK, "t", "x", "y", "total", (F.row_number().over(inside) - 1 + F.col("offset")).alias("i"))
    sorted_ = ranked.sortWithinPartitions("s", "i").select("s", "i", "x", "y", "total")
    hulls = sorted_.mapInArrow(_bucket_hulls(n), f"s {kind}, {CORNERS}")
    in_order = hulls.repartition("s").sortWithinPartitions("s", "b", F.col("i")[0])
    out = in_order.mapInArrow(_chosen(n, to_arrow_type(parts.schema["s"].dataType)), f"s {kind}, i bigint, x double, y double")
    return out.select(F.col("s").alias(series), "i", "x", "y")


# --- cohorts ------------------------------------------------------------------


def cohort_retention(visits: DataFrame, user: str, day: str) -> DataFrame:
    """Share of a cohort (first month) active in every later month."""
    months = visits.groupBy(user, F.trunc(day, "month").alias("m")).agg(F.count("*").alias("n"))
    first = months.groupBy(user).agg(F.min("m").alias("cohort"))
    joined = months.join(first, user).withColumn(
        "period", ((F.year("m") - F.year("cohort")) * 12 + F.month("m") - F.month("cohort")).cast("int")
    )
    cells = joined.groupBy("cohort", "period").agg(F.count("*").alias("active"))
    size = F.max(F.when(F.col("period") == 0, F.col("active"))).over(Window.partitionBy("cohort"))
    return cells.withColumn("cohort_size", size).withColumn("retention", ratio("active", "cohort_size"))


def cohort_grid(cells: DataFrame, periods: int) -> DataFrame:
    return cells.groupBy("cohort").pivot("period", list(range(periods))).agg(F.first("retention"))


# --- metric queries -------------------------------------------------------------


def increase(metrics: DataFrame, labels: list[str], ts: str, value: str, as_of: Column, window: str) -> DataFrame:
    """Growth of a counter inside the window; a drop is a restart from zero.
    Neighbours are found in chunks, so a busy label is no single task."""
    recent = metrics.where((F.col(ts) > as_of - F.expr(f"INTERVAL {window}")) & (F.col(ts) <= as_of))
    steps = prefix.previous(recent.select(*labels, ts, value), labels, [ts, value], {"_prev": value})
    prev = F.col("_prev")
    step = F.when(prev.isNull(), 0).when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev)
    return steps.withColumn("_step", step).groupBy(*labels).agg(F.sum("_step").alias("increase"))


def rate(metrics, labels, ts, value, as_of: Column, window: str, seconds: int) -> DataFrame:
    return increase(metrics, labels, ts, value, as_of, window).select(*labels, (dbl("increase") / seconds).alias("rate"))


def sum_by(metrics, labels, value: str) -> DataFrame:
    return metrics.groupBy(*labels).agg(dbl(F.sum(value)).alias("value"))


def avg_by(metrics, labels, value: str) -> DataFrame:
    return metrics.groupBy(*labels).agg(ratio(F.sum(value), F.count(value)).alias("value"))


def topk(metrics, k: int, value: str, tie: str) -> DataFrame:
    return metrics.orderBy(F.desc(value), tie).limit(k)


def success_ratio(runs, labels, below: float = 0.95) -> DataFrame:
    r = ratio(F.count_if(F.col("status") == "SUCCESS"), F.count("*"))
    return runs.groupBy(*labels).agg(r.alias("ratio")).withColumn("firing", F.col("ratio") < below)


DIGIT = 16  # bits that one aggregation of a selection decides


@F.pandas_udf(LongType())
def _ordered_bits(v: pd.Series) -> pd.Series:
    """Whole numbers in the order of the doubles; NaN is the largest."""
    x = np.where(np.isnan(v.to_numpy(np.float64)), np.nan, v.to_numpy(np.float64)) + 0.0
    bits = x.view(np.int64)
    return pd.Series(np.where(np.isnan(x), np.int64(0x7FF8 << 48), bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))))


@F.pandas_udf(DoubleType())
def _from_bits(k: pd.Series) -> pd.Series:
    bits = k.to_numpy(np.int64)
    return pd.Series((bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))).view(np.float64))


def quantiles(metrics, labels, value: str, qs=(0.5, 0.95), approximate=False) -> DataFrame:
    """Interpolated quantiles per label set, null where it has no value.

    Radix selection: values become whole numbers of the same order, and four
    aggregations decide 16 bits each, for all labels and ranks at once: rows are
    counted by (label, bits so far, next digit), and running counts over the
    digits find the one a rank falls into. No label's values are gathered or
    sorted. ``approximate`` takes one pass with a sketch instead."""
    if approximate:
        return metrics.groupBy(*labels).agg(*[F.percentile_approx(value, q, 10000).alias(f"p{int(q * 100)}") for q in qs])
    rows = checkpointed(metrics.select(F.struct(*labels).alias("g"), dbl(value).alias("v")))
    keyed = rows.where("v IS NOT NULL").select("g", _ordered_bits("v").alias("k"))
    sizes = rows.groupBy("g").agg(F.count("v").alias("n"))
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    asked = F.array(*[F.struct(F.lit(j).alias("q"), F.lit(up).alias("up"), (F.ceil if up else F.floor)(place(q)).alias("rank")) for j, q in enumerate(qs) for up in (False, True)])
    ranks = sizes.where("n > 0").select("g", F.explode(asked).alias("a")).select("g", "a.*", F.lit(0).cast("bigint").alias("bits"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        if shift == 64 - DIGIT:
            part = keyed.withColumn("bits", F.lit(0).cast("bigint"))
        else:
            part = keyed.withColumn("bits", F.shiftright("k", shift + DIGIT)).join(ranks.select("g", "bits").distinct(), ["g", "bits"])
        counts = part.groupBy("g", "bits", F.shiftright("k", shift).alias("next")).agg(F.count("*").alias("c"))
        # At most 2**16 counts per label and digit, whatever the number of rows.
        upto = F.sum("c").over(Window.partitionBy("g", "bits").orderBy("next"))
        cells = counts.select("g", "bits", "next", (upto - F.col("c")).alias("low"), upto.alias("high"))
        met = ranks.join(cells, ["g", "bits"]).where("rank >= low AND rank < high")
        ranks = checkpointed(met.select("g", "q", "up", (F.col("rank") - F.col("low")).alias("rank"), F.col("next").alias("bits")))
    found = ranks.withColumn("v", _from_bits("bits")).groupBy("g").agg(
        *[F.max(F.when((F.col("q") == j) & (F.col("up") == F.lit(up)), F.col("v"))).alias(f"v{j}{int(up)}") for j in range(len(qs)) for up in (False, True)]
    )
    out = sizes.join(found, "g", "left")
    made = []
    for j, q in enumerate(qs):
        low, high, at = F.col(f"v{j}0"), F.col(f"v{j}1"), place(q)
        mixed = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
        made.append(F.when(low == high, low).otherwise(mixed).alias(f"p{int(q * 100)}"))
    return out.select("g.*", *made)


def firing_for(series: DataFrame, keys: list[str], ts: str, condition: Column, seconds: int) -> DataFrame:
    """Spans in which the condition holds on every sample for at least
    ``seconds``. Samples of one instant are taken in the order of the condition,
    broken ones first; breaks are counted in chunks."""
    marked = series.select(*keys, ts, F.coalesce(condition, F.lit(False)).alias("_on"))
    counted = prefix.running(marked, keys, [ts, "_on"], {"_g": F.when(F.col("_on"), 0).otherwise(1).cast("long")})
    spans = counted.where("_on").groupBy(*keys, "_g").agg(
        F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("samples")
    )
    held = F.unix_timestamp("ended") - F.unix_timestamp("started")
    return spans.where(held >= seconds).drop("_g")
