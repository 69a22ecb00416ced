"""Ordered computations that stay parallel inside one hot key.

A plain window ``PARTITION BY key ORDER BY ts`` puts every row of a key into one
task. Here rows are first cut into chunks along the order by Spark's own range
partitioning: the window runs inside ``(key, chunk)``, the chunk totals (few
rows per key) are accumulated on their own, and both are joined back on
``(key, chunk)``. A key that holds most of the table is then spread over as many
tasks as a shuffle has partitions, whatever the size of the table.

Null keys form a key of their own; null order values come first.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.session import checkpointed

CHUNK = "_chunk"


def cut(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows with their chunk number, which does not decrease along ``order``.

    There are as many chunks as a shuffle has partitions. The cut is kept in a
    checkpoint, so all steps that follow (and retried tasks) see the same one.
    """
    chunks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(chunks, *order).withColumn(CHUNK, F.spark_partition_id()))


def _chunked(df: DataFrame, order: list[str], chunk: Column | None) -> DataFrame:
    return cut(df, order) if chunk is None else df.withColumn(CHUNK, chunk)


def _joined(rows: DataFrame, per_chunk: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their (key, chunk); null keys meet each other."""
    names = [*keys, CHUNK]
    side = per_chunk.withColumnsRenamed({n: f"_j{i}" for i, n in enumerate(names)})
    same = reduce(and_, [rows[n].eqNullSafe(side[f"_j{i}"]) if n != CHUNK else rows[n] == side[f"_j{i}"] for i, n in enumerate(names)])
    return rows.join(side, same).drop(*[f"_j{i}" for i in range(len(names))])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    row_number: str | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Add running sums and a row number per key, in the given order.

    ``order`` should end in a unique column. A given ``chunk`` must not decrease
    along the order.
    """
    sums = dict(sums or {})
    if row_number:
        sums[row_number] = F.lit(1).cast("long")
    parts = _chunked(df, order, chunk).withColumns({f"_v_{n}": c for n, c in sums.items()})
    totals = parts.groupBy(*keys, CHUNK).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, CHUNK, *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums]
    )
    inside = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = parts.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in sums])
    out = _joined(local, offsets, keys)
    return out.select(
        *[out[c] for c in df.columns],
        *[
            (F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n)
            for n in sums
        ],
    )


def previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, str],
    following: bool = False,
    chunk: Column | None = None,
) -> DataFrame:
    """Add the neighbouring row's columns per key: the previous one, or the
    next one with ``following``. ``values`` maps new name to column."""
    parts = _chunked(df, order, chunk)
    payload = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    edge, toward = (F.min_by, F.desc) if following else (F.max_by, F.asc)
    last = parts.groupBy(*keys, CHUNK).agg(edge(payload, F.struct(*order)).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy(toward(CHUNK))
    carried = last.select(*keys, CHUNK, F.lag("_edge").over(across).alias("_carry"))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*[toward(o) for o in order])
    local = parts.withColumns(
        {"_near": F.lag(payload).over(inside), "_first": F.row_number().over(inside) == 1}
    )
    joined = _joined(local, carried, keys)
    picked = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_near"))
    return joined.withColumn("_p", picked).select(
        *[joined[c] for c in df.columns], *[F.col(f"_p.{n}").alias(n) for n in values]
    )


def max_before(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, chunk: Column | None = None
) -> DataFrame:
    """Largest ``value`` of all earlier rows of the key."""
    parts = _chunked(df, order, chunk)
    rows_before = (Window.unboundedPreceding, -1)
    tops = parts.groupBy(*keys, CHUNK).agg(F.max(value).alias("_top"))
    across = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(*rows_before)
    carried = tops.select(*keys, CHUNK, F.max("_top").over(across).alias("_carry"))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(*rows_before)
    joined = _joined(parts.withColumn("_near", F.max(value).over(inside)), carried, keys)
    return joined.select(
        *[joined[c] for c in df.columns], F.greatest("_near", "_carry").alias(name)
    )


def trailing_count(df: DataFrame, keys: list[str], ts: str, uid: str, seconds: int, name: str) -> DataFrame:
    """Count rows of the same key in ``[ts - seconds, ts]`` for every row.

    The count is the difference of two running counts. Each row adds a probe
    before its range and one behind it; probes and rows are counted together in
    time order, split by chunk, so neither a busy key nor a busy minute meets
    in one task. ``uid`` identifies a row.
    """
    at = F.unix_micros(F.col(ts))
    mark = F.explode(
        F.array(
            F.struct((at - seconds * 1_000_000).alias("_at"), F.lit(0).alias("_kind")),
            F.struct(at.alias("_at"), F.lit(1).alias("_kind")),
            F.struct(at.alias("_at"), F.lit(2).alias("_kind")),
        )
    )
    points = df.select(*keys, F.col(uid).alias("_uid"), mark.alias("_m")).select(*keys, "_uid", "_m.*")
    counted = running(points, keys, ["_at", "_kind", "_uid"], {"_seen": F.when(F.col("_kind") == 1, 1).otherwise(0).cast("long")})
    sign = F.when(F.col("_kind") == 2, F.col("_seen")).when(F.col("_kind") == 0, -F.col("_seen"))
    found = counted.groupBy("_uid").agg(F.sum(sign).alias(name))
    return df.join(found, F.col(uid) == F.col("_uid")).drop("_uid")


def values_at_ranks(df: DataFrame, value: str, fractions: list[float], bins: int = 4096) -> list:
    """Values at the 0-based positions ``floor(n * q)`` of the sorted column.

    Exact and distributed: counts per equal-width bin (at most ``bins`` rows
    reach the driver) find the bin of a rank, which is divided again until it
    holds a single value. A value that fills a third of the table is one bin.
    Null, NaN and infinite values have no rank.
    """
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(v.alias("v"))
    lo, hi, n = base.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return [None for _ in fractions]
    results = []
    for q in fractions:
        rank, a, b = min(int(n * q), n - 1), lo, hi
        while True:
            part = base.where((F.col("v") >= a) & (F.col("v") <= b))
            width = (b - a) / bins
            if 0 < width < float("inf"):  # the last bin takes the upper edge
                bin_no = F.least(F.floor((F.col("v") - a) / width), F.lit(bins - 1))
            elif width:  # the difference of the bounds overflows
                bin_no = (F.col("v") > 0).cast("int")
            else:  # bounds too close to divide: at most ``bins`` different numbers lie between
                bin_no = F.col("v")
            cells = sorted(
                part.groupBy(bin_no.alias("bin"))
                .agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
                .collect()
            )
            for cell in cells:
                if rank < cell.c:
                    a, b = cell.a, cell.b
                    break
                rank -= cell.c
            if a == b:
                results.append(a)
                break
    return results
