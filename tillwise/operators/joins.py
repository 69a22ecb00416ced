"""Joins of facts, dimensions and time intervals.

No join carries a broadcast hint on a table that can grow: sides below the
session's threshold are broadcast by Spark from their measured size, all
others are sort-merge joins with adaptive skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import prefix
from tillwise.functions.columns import percent


def lookup(fact, dim, fact_key: str, dim_key: str, columns: dict[str, str], required=False) -> DataFrame:
    """Add dimension columns; a nullable key keeps its row (left join)."""
    d = dim.select(F.col(dim_key).alias("_key"), *[F.col(c).alias(n) for n, c in columns.items()])
    return fact.join(d, F.col(fact_key) == F.col("_key"), "inner" if required else "left").drop("_key")


def resolve_keys(fact, dims: list[dict], flag: str = "quarantined") -> DataFrame:
    """Resolve natural keys through the dimensions; ``flag`` marks rows with an
    unresolved required key.

    ``dims``: dicts with table, natural, fact_key, surrogate, as, required.
    """
    df = fact
    bad = F.lit(False)
    for d in dims:
        side = d["table"].select(F.col(d["natural"]).alias("_nk"), F.col(d["surrogate"]).alias(d["as"]))
        df = df.join(side, F.col(d["fact_key"]) == F.col("_nk"), "left").drop("_nk")
        if d.get("required", True):
            bad = bad | F.col(d["as"]).isNull()
    return df.withColumn(flag, bad)


def counts_by_parent(parents, key: str, children: dict[str, tuple[DataFrame, list[Column]]]) -> DataFrame:
    """Aggregate every child table by the parent key before joining it; parents
    without children get zeros, their own columns stay as they are."""
    out = parents
    for df, aggregates in children.values():
        out = out.join(df.groupBy(key).agg(*aggregates), key, "left")
    return out.na.fill(0, [c for c in out.columns if c not in parents.columns])


def new_only(incoming, existing, keys: list[str]) -> DataFrame:
    return incoming.join(existing.select(*keys), keys, "left_anti")


def orphans(child, child_key: str, parent, parent_key: str) -> DataFrame:
    """Distinct non-null child keys without a parent, with their row counts."""
    keys = child.where(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count("*").alias("rows"))
    return keys.join(parent, F.col(child_key) == F.col(parent_key), "left_anti")


def orphan_rate(child, child_key: str, parent, parent_key: str, threshold: float) -> DataFrame:
    lost = orphans(child, child_key, parent, parent_key).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).scalar()
    return child.agg(F.count(child_key).alias("checked")).select(
        "checked",
        lost.alias("orphans"),
        percent(lost, F.col("checked"), 0).alias("orphan_rate"),
        (percent(lost, F.col("checked"), 0) <= threshold * 100).alias("passed"),
    )


def case_insensitive(left, right, left_name: str, right_name: str, keys: list[str]) -> DataFrame:
    a = left.withColumn("_n", F.lower(left_name))
    b = right.withColumn("_n", F.lower(right_name))
    return a.join(b, [*keys, "_n"]).drop("_n")


def subject_rows(maps, subjects, ids: str = "subject_ids") -> DataFrame:
    """Rows whose id list holds the subject: explode, then an equi join."""
    one = maps.withColumn("subject_id", F.explode(F.array_distinct(ids))).drop(ids)
    return one.join(subjects, "subject_id")


def merge_intervals(df, keys: list[str], start: str, end: str) -> DataFrame:
    """Union of overlapping ``[start, end)`` intervals per key, so that a point
    can lie in one interval at most."""
    slim = prefix.cut(df.select(*keys, start, end).distinct(), [start, end])
    chunk = F.col(prefix.CHUNK)
    seen = prefix.max_before(slim, keys, [start, end], end, "_seen", chunk)
    opens = F.when(F.col("_seen").isNull() | (F.col(start) > F.col("_seen")), 1).otherwise(0).cast("long")
    grouped = prefix.running(seen, keys, [start, end], {"_g": opens}, chunk=chunk)
    return grouped.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def points_in_intervals(points, intervals, keys: list[str], ts: str, start: str, end: str) -> DataFrame:
    """Interval join on equal keys and ``start <= ts < end``; intervals of a key
    must not overlap.

    Points and starts are put into one order, and the last start is carried
    forward in chunks: one sort, no pairing and no copies of long intervals.
    """
    spans = intervals.where(F.col(start) < F.col(end))
    rest = [c for c in spans.columns if c not in (*keys, start)]
    span, row = F.struct(start, *rest), F.struct(*points.columns)
    kind = dict(both_kinds(spans, span, points, row))
    starts = spans.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_side"), span.alias("_span"), F.lit(None).cast(kind["row"]).alias("_row"))
    asked = points.select(*keys, F.col(ts).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind["span"]).alias("_span"), row.alias("_row"))
    carried = prefix.max_before(starts.unionByName(asked), keys, ["_at", "_side"], "_span", "_last")
    inside = carried.where(F.col("_row").isNotNull() & (F.col("_at") < F.col("_last")[end]))
    return inside.select("_row.*", "_last.*")


LEVELS = 40  # at most: levels of the interval index


def covering(points, intervals, keys: list[str], ts: str, start: str, end: str) -> DataFrame:
    """All pairs of a point and an interval that covers it: equal keys and
    ``start <= ts < end``. Intervals may overlap in any way.

    Time is cut into cells, about as many as there are intervals. An interval
    becomes at most two dyadic nodes per level, a point the nodes above its
    cell, so the pairs come from an equi join on (key, level, node); the times
    themselves decide in the cells an interval covers in part. Levels without a
    node are left out of the points' paths. Null times and empty intervals meet
    nothing. Sizes, range and levels are asked for first.
    """
    span = intervals.where(F.col(start) < F.col(end)).withColumns({"_a": F.unix_micros(start), "_b": F.unix_micros(F.col(end))})
    low, high, count = span.agg(F.min("_a"), F.max("_b"), F.count("*")).first()
    rest = [c for c in intervals.columns if c not in keys]
    clash = set(rest) & set(points.columns)
    if clash:
        raise ValueError(f"points and intervals share columns: {sorted(clash)}")
    if not count:
        return points.join(intervals, keys).limit(0)
    top = min(LEVELS, max(1, (count - 1).bit_length()))
    width = max(1, -(-(high - low) // (1 << top)))
    level = F.sequence(F.lit(0), F.lit(top))
    cell = lambda c: F.floor((c - F.lit(low)) / F.lit(width)).cast("bigint")

    def nodes(j: Column) -> Column:
        # The cells [first, behind) at level j that no node above takes.
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), j)
        first = F.floor((F.col("_first") + size - 1) / size).cast("bigint")
        behind = F.floor((F.col("_last") + 1) / size).cast("bigint")
        node = lambda n: F.struct(j.alias("level"), n.alias("node"))
        left = F.when((first < behind) & ((first % 2 == 1) | (j == top)), node(first))
        right = F.when((first < behind) & (behind % 2 == 1) & ((j < top) | (behind - 1 > first)), node(behind - 1))
        return F.array(left, right)

    cells = span.withColumns({"_first": cell(F.col("_a")), "_last": cell(F.col("_b") - 1)})
    spread = cells.withColumn("_n", F.explode(F.array_compact(F.flatten(F.transform(level, nodes))))).select(*keys, *rest, "_n.level", "_n.node")
    used = sorted(r[0] for r in spread.select("level").distinct().collect())
    known = points.withColumn("_c", cell(F.unix_micros(ts))).where((F.unix_micros(ts) >= low) & (F.unix_micros(ts) < high))
    above = F.array(*[F.struct(F.lit(j).alias("level"), F.shiftright("_c", j).alias("node")) for j in used])
    paths = known.withColumn("_n", F.explode(above)).select(*points.columns, "_n.level", "_n.node")
    met = paths.join(spread, [*keys, "level", "node"])
    return met.where((F.col(start) <= F.col(ts)) & (F.col(ts) < F.col(end))).select(*points.columns, *rest)


def both_kinds(spans, span, points, row) -> list[tuple[str, str]]:
    """Types of the two packed columns."""
    return [("span", spans.select(span.alias("s")).dtypes[0][1]), ("row", points.select(row.alias("r")).dtypes[0][1])]


def as_of_versions(usage, versions, key: str, ts: str, created: str, version: str, horizon: Column) -> DataFrame:
    """Version in force at the time of use: each version is valid until the
    next one of its key, which makes it an interval join."""
    spans = prefix.previous(
        versions.select(key, version, created), [key], [created, version], {"_next": created}, following=True,
    ).withColumn("_until", F.coalesce("_next", horizon)).drop("_next")
    return points_in_intervals(usage, spans, [key], ts, created, "_until").drop("_until")
