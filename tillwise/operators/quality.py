"""Data-quality rules, fused per table.

Rules are plain dicts ``{name, check_type, column, threshold, severity,
params}``. All scan-type rules of a table compile to aggregate columns of one
``agg``; the single result row is unfolded into one row per rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.columns import dbl, percent, ratio
from tillwise.operators import joins

# Severity ladder, lowest first; WARN and MEDIUM are one step.
SEVERITY_RANK = {"INFO": 0, "LOW": 1, "WARN": 2, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
COMPARISONS = {
    "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b,
}


COLUMN_CHECKS = ("null_rate", "uniqueness", "range_check", "cardinality", "timeliness")


@dataclass
class Compiled:
    """Aggregates of a rule and how its verdict is read from them."""

    aggregates: dict[str, Column]
    rows: Column
    violations: Column
    metric: Column
    passed: Column


def compile_rule(rule: dict, i: int, as_of: Column | None = None) -> Compiled:
    kind, column, t = rule["check_type"], rule.get("column"), rule.get("threshold")
    p = rule.get("params", {})
    n, x = f"_{i}_n", f"_{i}_x"
    rows = F.col(n)
    count = {n: F.count("*")}
    if kind == "row_count":
        if "min_rows" in p or "max_rows" in p:
            ok = (F.col(n) >= p.get("min_rows", 0)) & (F.col(n) <= p.get("max_rows", 2**62))
        else:
            ok = COMPARISONS[p.get("comparison", "gte")](F.col(n), F.lit(t))
        return Compiled(count, rows, F.when(ok, 0).otherwise(1).cast("long"), dbl(n), ok)
    if kind not in COLUMN_CHECKS:
        raise ValueError(f"unknown check type {kind}")
    v = F.col(column)
    if kind == "null_rate":
        aggs = count | {x: F.count_if(v.isNull())}
        m = ratio(x, n, 0)
        return Compiled(aggs, rows, F.col(x), m, m <= t)
    if kind == "uniqueness":
        aggs = count | {x: F.count_distinct(v), f"_{i}_v": F.count(v)}
        dup = F.col(f"_{i}_v") - F.col(x)
        if "min_uniqueness_rate" in p:
            m = ratio(x, f"_{i}_v", 1)
            return Compiled(aggs, rows, dup, m, m >= p["min_uniqueness_rate"])
        return Compiled(aggs, rows, dup, dbl(dup), dup <= t)
    if kind == "range_check":
        bad = F.lit(False)
        if p.get("min_value") is not None:
            bad = bad | (v < p["min_value"])
        if p.get("max_value") is not None:
            bad = bad | (v > p["max_value"])
        aggs = {n: F.count(v), x: F.count_if(bad)}
        m = ratio(x, n, 0)
        return Compiled(aggs, rows, F.col(x), m, m <= t)
    if kind == "cardinality":
        distinct = F.approx_count_distinct(v, 0.02) if p.get("approximate") else F.count_distinct(v)
        ok = COMPARISONS[p.get("comparison", "lte")](F.col(x), F.lit(t))
        return Compiled(count | {x: distinct}, rows, F.when(ok, 0).otherwise(1).cast("long"), dbl(x), ok)
    # timeliness
    aggs = count | {x: F.max(v)}
    age = (F.unix_micros(as_of) - F.unix_micros(F.col(x))) / 1_000_000
    ok = F.coalesce(age <= t + p.get("grace_seconds", 0), F.lit(False))
    return Compiled(aggs, rows, F.when(ok, 0).otherwise(1).cast("long"), age, ok)


def run_rules(df: DataFrame, rules: list[dict], as_of: Column | None = None, window: Column | None = None) -> DataFrame:
    """All enabled scan-type rules of one table in one pass."""
    rules = [r for r in rules if r.get("enabled", True)]
    compiled = [compile_rule(r, i, as_of) for i, r in enumerate(rules)]
    aggs = [c.alias(name) for k in compiled for name, c in k.aggregates.items()]
    base = df.where(window) if window is not None else df
    one = base.agg(*aggs)
    rows = [
        F.struct(
            F.lit(r["name"]).alias("rule"),
            F.lit(r["check_type"]).alias("check_type"),
            k.rows.alias("rows_scanned"),
            k.violations.alias("violations_count"),
            k.metric.alias("metric_value"),
            F.lit(float(r["threshold"] if r.get("threshold") is not None else 0)).alias("threshold"),
            k.passed.alias("passed"),
            F.lit(r.get("severity", "MEDIUM")).alias("severity"),
        )
        for r, k in zip(rules, compiled)
    ]
    return one.select(F.inline(F.array(*rows)))


def select_rules(rules: list[dict], names=None, check_types=None, severities=None) -> list[dict]:
    """Rules by name, type or severity; no argument selects all."""
    return [
        r for r in rules
        if (not names or r["name"] in names)
        and (not check_types or r["check_type"] in check_types)
        and (not severities or r.get("severity") in severities)
    ]


def ref_integrity(rule: dict, child: DataFrame, parent: DataFrame) -> DataFrame:
    """Share of non-null child keys without a parent."""
    p = rule["params"]
    for need in ("ref_table", "ref_column"):
        if need not in p:
            raise ValueError(f"ref_integrity needs {need}")
    lost = joins.orphans(child, rule["column"], parent, p["ref_column"])
    bad = lost.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).scalar()
    return child.agg(F.count(rule["column"]).alias("rows_scanned")).select(
        F.lit(rule["name"]).alias("rule"),
        "rows_scanned",
        bad.alias("violations_count"),
        ratio(bad, "rows_scanned", 0).alias("metric_value"),
        (ratio(bad, "rows_scanned", 0) <= rule["threshold"]).alias("passed"),
    )


def schema_drift(df: DataFrame, baseline: dict[str, str], ignore_new=False, include_types=True) -> list[tuple[str, str]]:
    """``(column, added | removed | retyped)`` against a baseline name → type."""
    actual = dict(df.dtypes)
    out = [(c, "removed") for c in baseline if c not in actual]
    if not ignore_new:
        out += [(c, "added") for c in actual if c not in baseline]
    if include_types:
        out += [(c, "retyped") for c in baseline if c in actual and actual[c] != baseline[c]]
    return sorted(out)


def payload_drift(df: DataFrame, json_column: str, baseline: dict[str, str]) -> DataFrame:
    """Fields of a JSON payload that differ from a baseline field → type, with
    the rows that carry them; from the data, not from a sample."""
    parsed = F.from_json(F.col(json_column), "map<string,string>")
    kind = lambda v: (
        F.when(v.rlike(r"^-?\d+$"), "bigint").when(v.try_cast("double").isNotNull(), "double").when(v.isin("true", "false"), "boolean").otherwise("string")
    )
    fields = df.select(F.explode(parsed).alias("field", "v")).groupBy("field", kind(F.col("v")).alias("type")).agg(F.count("*").alias("rows"))
    spark: SparkSession = df.sparkSession
    known = spark.createDataFrame(list(baseline.items()), T.StructType([T.StructField("field", T.StringType()), T.StructField("expected", T.StringType())]))
    j = fields.join(known, "field", "full_outer")
    change = F.when(F.col("expected").isNull(), "added").when(F.col("type").isNull(), "removed").when(F.col("type") != F.col("expected"), "retyped")
    return j.withColumn("change", change).where(F.col("change").isNotNull()).select("field", "type", "expected", "change", F.coalesce("rows", F.lit(0)).alias("rows"))


def volume(df: DataFrame, ts: str, bucket: str) -> DataFrame:
    return df.groupBy(F.date_trunc(bucket, ts).alias("bucket")).agg(F.count("*").alias("volume"))


def volume_anomaly(counts: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Deviation of the newest bucket from the mean of the others."""
    last = counts.agg(F.max("bucket").alias("m")).scalar()
    return counts.agg(
        F.max(F.when(F.col("bucket") == last, F.col("volume"))).alias("current_volume"),
        ratio(F.sum(F.when(F.col("bucket") < last, F.col("volume"))), F.count_if(F.col("bucket") < last)).alias("expected_volume"),
    ).select(
        "current_volume",
        "expected_volume",
        (F.abs(F.col("current_volume") - F.col("expected_volume")) / F.col("expected_volume")).alias("deviation"),
        (F.abs(F.col("current_volume") - F.col("expected_volume")) / F.col("expected_volume") <= threshold).alias("passed"),
    )


def custom_query(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Rule with its own Spark SQL; frames are passed by name."""
    return spark.sql(sql, **tables)


def suggest(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    """Suggested rules: general ones, ones known from the table's name, and
    ones the data keeps today (no nulls, no negatives), from one profile."""
    # Names, thresholds and severities of the suggested rules.
    fixed = [(f"{table}_row_count_check", "row_count", None, 1.0, "CRITICAL"), (f"{table}_primary_key_uniqueness", "uniqueness", key, 0.0, "CRITICAL")]
    if "sales" in table.lower():
        fixed += [
            (f"{table}_total_amount_not_null", "null_rate", "total_amount", 0.01, "CRITICAL"),
            (f"{table}_positive_amounts", "range_check", "total_amount", 0.0, "CRITICAL"),
        ]
    if "inventory" in table.lower():
        fixed.append((f"{table}_stock_levels", "range_check", "current_stock", 0.0, "WARN"))
    numeric = [n for n, k in df.dtypes if k in ("int", "bigint", "double") or k.startswith("decimal")]
    profile = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}|null") for c in df.columns],
        *[F.min(c).cast("double").alias(f"{c}|min") for c in numeric],
    )

    def entry(name, kind, column, threshold, severity, keep=None):
        s = F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("check_type"), F.lit(column).cast("string").alias("column"),
            F.lit(threshold).alias("threshold"), F.lit(severity).alias("severity"),
        )
        return s if keep is None else F.when(keep, s)

    rows = [entry(*f) for f in fixed]
    rows += [entry(f"{table}_{c}_not_null", "null_rate", c, 0.0, "MEDIUM", F.col(f"`{c}|null`") == 0) for c in df.columns]
    rows += [entry(f"{table}_{c}_not_negative", "range_check", c, 0.0, "MEDIUM", F.col(f"`{c}|min`") >= 0) for c in numeric]
    return profile.select(F.inline(F.array_compact(F.array(*rows))))


def violation_rows(df: DataFrame, rules: list[tuple[str, Column]], key: list[str], sample: int = 100) -> DataFrame:
    """Sample of offending rows per rule as JSON, first by key; one scan. The
    per-rule limit runs before the shuffle."""
    hits = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    one = df.withColumn("rule", F.explode(hits))
    w = Window.partitionBy("rule").orderBy(*key)
    return one.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= sample).select(
        "rule", F.to_json(F.struct(*df.columns)).alias("record")
    )


def metric_rows(runs: DataFrame) -> DataFrame:
    """Runs as long metrics: duration, violations, rows scanned, pass rate."""
    wide = runs.select(
        "rule_id",
        "finished_at",
        dbl("duration_seconds").alias("duration"),
        dbl("violations_count").alias("violations"),
        dbl("rows_scanned").alias("rows_scanned"),
        percent(F.col("rows_scanned") - F.col("violations_count"), F.col("rows_scanned"), 0).alias("pass_rate"),
    )
    return wide.unpivot(["rule_id", "finished_at"], ["duration", "violations", "rows_scanned", "pass_rate"], "metric_name", "value")


def acknowledge(violations: DataFrame, which: Column, user: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """Mark the chosen violations that are not acknowledged yet; and how many."""
    hit = which & ~F.col("acknowledged")
    out = violations.withColumns(
        {
            "acknowledged": F.col("acknowledged") | which,
            "acknowledged_by": F.when(hit, F.lit(user)).otherwise(F.col("acknowledged_by")),
            "acknowledged_at": F.when(hit, now).otherwise(F.col("acknowledged_at")),
        }
    )
    return out, violations.agg(F.count_if(hit).alias("acknowledged_count"))


# Alert channels by severity.
CHANNELS = {
    "CRITICAL": ("email", "slack", "pagerduty"),
    "HIGH": ("email", "slack"),
    "MEDIUM": ("email",),
    "LOW": ("slack",),
    "INFO": (),
}


def alert_routing(runs: DataFrame, severity: str = "severity") -> DataFrame:
    """One row per alert and channel with a de-duplication key."""
    route = None
    for s, channels in CHANNELS.items():
        targets = F.array(*[F.lit(c) for c in channels]).cast("array<string>")
        cond = F.col(severity) == s
        route = F.when(cond, targets) if route is None else route.when(cond, targets)
    return runs.withColumns(
        {"dedup_key": F.concat_ws("-", F.lit("dq"), "rule_id", "run_id"), "channel": F.explode(route.otherwise(F.array(F.lit("email"))))}
    )
