"""Catalogue: anomaly detection on run histories."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F


from tillwise.operators import anomaly, marts
from tillwise.plans.registry import query
from tillwise.session import checkpointed, scratch_path


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


HIST = """h AS (SELECT *, CAST(violations_count AS DOUBLE) AS v, count(*) OVER r AS n, avg(violations_count) OVER r AS mean, stddev_pop(violations_count) OVER r AS std,
  row_number() OVER (PARTITION BY rule_id ORDER BY finished_at DESC, run_id DESC) AS back FROM dq_runs WINDOW r AS (PARTITION BY rule_id))"""


def z_sql(threshold: float, method: str) -> str:
    t = f"{threshold!r}::DOUBLE"
    return f"""
WITH {HIST}, z AS (SELECT *, CASE WHEN std > 0 THEN abs(v - mean) / std END AS z FROM h WHERE n >= 10 AND back <= 5)
SELECT rule_id, run_id, '{method}' AS method, CASE WHEN std > 0 THEN z > {t} ELSE v <> mean END AS is_anomaly, round(CASE WHEN z > {t} THEN least(z / {t}, 1.0) ELSE 0.0 END, 6) AS confidence,
  round({t}, 6) AS threshold_value, v AS actual_value, round(greatest(0.0, mean - std * {t}), 6) AS expected_min, round(mean + std * {t}, 6) AS expected_max, round(z, 6) AS score FROM z"""


ROUNDED = ("confidence", "threshold_value", "expected_min", "expected_max", "score")


@query("anom_statistical", z_sql(NormalDist().inv_cdf(0.9), "statistical"))
def _(t):
    return rounded(anomaly.statistical(t.dq_runs, 0.2), *ROUNDED)


@query("anom_zscore", z_sql(2.5, "z_score"))
def _(t):
    return rounded(anomaly.zscore(t.dq_runs, 0.2), *ROUNDED)


IQR_SQL = f"""{HIST}, q AS (SELECT rule_id, quantile_cont(CAST(violations_count AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(violations_count AS DOUBLE), 0.75) AS q3 FROM dq_runs GROUP BY 1),
b AS (SELECT *, q1 - (q3 - q1) AS lo, q3 + (q3 - q1) AS hi FROM h JOIN q USING (rule_id) WHERE n >= 10 AND back <= 200),
found AS (SELECT rule_id, run_id, 'iqr' AS method, v < lo OR v > hi AS is_anomaly, round(CASE WHEN (v < lo OR v > hi) AND q3 > q1 THEN least(least(abs(v - lo), abs(v - hi)) / (q3 - q1), 1.0) ELSE 0.0 END, 6) AS confidence,
  1.0::DOUBLE AS threshold_value, v AS actual_value, greatest(0.0, lo) AS expected_min, hi AS expected_max FROM b)"""


@query("anom_iqr", f"WITH {IQR_SQL} SELECT * FROM found")
def _(t):
    return rounded(anomaly.iqr(t.dq_runs, 0.2, last=200), "confidence")


@query("anom_store", f"WITH {IQR_SQL} SELECT rule_id, run_id, method AS detection_method, confidence AS anomaly_score, threshold_value, actual_value, expected_min, expected_max FROM found WHERE is_anomaly")
def _(t):
    path = scratch_path(t.spark, "anomalies")
    anomaly.only_anomalies(anomaly.iqr(t.dq_runs, 0.2, last=200)).write.mode("append").parquet(path)
    return rounded(t.spark.read.parquet(path), "anomaly_score")


@query(
    "anom_change_point",
    """
WITH a AS (SELECT rule_id, run_id, finished_at, CAST(violations_count AS DOUBLE) AS v, count(*) OVER (PARTITION BY rule_id) AS n, row_number() OVER w - 1 AS pos, sum(CAST(violations_count AS DOUBLE)) OVER w AS run
  FROM dq_runs WINDOW w AS (PARTITION BY rule_id ORDER BY finished_at, run_id)),
b AS (SELECT *, least(n // 4, 10) AS w FROM a WHERE n >= 10),
c AS (SELECT b.*, CASE WHEN b.pos >= b.w - 1 THEN (b.run - coalesce(p.run, 0)) / b.w END AS mean FROM b LEFT JOIN b p ON p.rule_id = b.rule_id AND p.pos = b.pos - b.w),
d AS (SELECT *, abs(lead(mean) OVER w - mean) AS size, lead(mean) OVER w - mean AS change FROM c WINDOW w AS (PARTITION BY rule_id ORDER BY pos)),
e AS (SELECT *, stddev_pop(change) OVER (PARTITION BY rule_id) * 2.0 AS height FROM d),
p AS (SELECT *, lag(size) OVER w AS l, lead(size) OVER w AS r, size IS DISTINCT FROM lag(size) OVER w AS opens FROM e WINDOW w AS (PARTITION BY rule_id ORDER BY pos)),
o AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id ORDER BY pos) AS top FROM p),
t AS (SELECT rule_id, top, min(pos) AS a, max(pos) AS b, min_by(l, pos) AS l, max_by(coalesce(r, -1), pos) AS r FROM o GROUP BY 1, 2),
f AS (SELECT o.*, coalesce(o.pos = (a + b) // 2 AND size > coalesce(t.l, 1e300) AND size > CASE WHEN t.r < 0 THEN 1e300 ELSE t.r END AND size >= height, false) AS peak FROM o JOIN t ON o.rule_id = t.rule_id AND o.top = t.top),
g AS (SELECT x.*, (SELECT min(abs(x.pos - y.pos)) FROM f y WHERE y.rule_id = x.rule_id AND y.peak AND abs(x.pos - y.pos) <= 2) AS near FROM f x WHERE pos >= n - 40)
SELECT rule_id, run_id, near IS NOT NULL AS is_anomaly, CASE WHEN near IS NOT NULL THEN 1.0::DOUBLE / (near + 1) ELSE 0.0 END AS confidence, round(height, 6) AS threshold_value, v AS actual_value, CAST(pos AS BIGINT) AS position FROM g""",
)
def _(t):
    out = anomaly.change_point(t.dq_runs, 0.05, last=40)
    return rounded(out, "threshold_value").select("rule_id", "run_id", "is_anomaly", "confidence", "threshold_value", "actual_value", F.col("position").cast("long").alias("position"))


def phase_sql(phase: str, method: str) -> str:
    return f"""
WITH p AS (SELECT *, {phase} AS phase, CAST(violations_count AS DOUBLE) AS v FROM dq_runs), s AS (SELECT rule_id, phase, avg(v) AS mean, stddev_pop(v) AS std FROM p GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY finished_at DESC, run_id DESC) AS back, count(*) OVER (PARTITION BY rule_id) AS n FROM p),
z AS (SELECT l.*, CASE WHEN std > 0 THEN abs(v - mean) / std END AS z FROM l JOIN s USING (rule_id, phase) WHERE back <= 5 AND n >= 14)
SELECT rule_id, run_id, '{method}' AS method, coalesce(z > 1.2, false) AS is_anomaly, round(CASE WHEN z > 1.2 THEN least(z / 1.2, 1.0) ELSE 0.0 END, 6) AS confidence, v AS actual_value FROM z"""


def phase_query(name, method, sql_phase, phase):
    @query(name, phase_sql(sql_phase, method))
    def _(t):
        return rounded(anomaly.seasonal(t.dq_runs, phase(), method, threshold=1.2), "confidence")


phase_query("anom_pattern_daily", "daily", "CAST(hour(finished_at) AS INTEGER)", lambda: F.hour("finished_at"))
phase_query("anom_pattern_weekly", "weekly", "CAST(dayofweek(finished_at) AS INTEGER)", lambda: F.dayofweek("finished_at") - 1)
phase_query("anom_seasonal", "seasonal", "CAST(dayofweek(finished_at) * 24 + hour(finished_at) AS INTEGER)", lambda: (F.dayofweek("finished_at") - 1) * 24 + F.hour("finished_at"))


def volume_sql(method: str) -> str:
    return f"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY finished_at DESC, run_id DESC) AS back FROM dq_runs WHERE rows_scanned > 0 AND finished_at >= (SELECT max(ts) FROM events) - INTERVAL 168 HOURS),
s AS (SELECT rule_id, CAST(max(rows_scanned) FILTER (back = 1) AS DOUBLE) AS cur, avg(rows_scanned) FILTER (back > 1) AS mean, stddev_pop(rows_scanned) FILTER (back > 1) AS std, count(*) FILTER (back > 1) AS n FROM v GROUP BY 1),
z AS (SELECT *, abs(cur - mean) / std AS z FROM s WHERE n >= 5)
SELECT rule_id, '{method}' AS method, z > 3.0 AS is_anomaly, round(CASE WHEN z > 3.0 THEN least(z / 3.0, 1.0) ELSE 0.0 END, 6) AS confidence, cur AS actual_value, n AS history_size, round(z, 6) AS score FROM z"""


@query("anom_volume_statistical", volume_sql("volume_statistical"))
def _(t):
    return rounded(anomaly.volume_statistical(t.dq_runs, marts.max_of(t.events, "ts"), "7d"), "confidence", "score")


@query("anom_volume_zscore", volume_sql("volume_zscore"))
def _(t):
    return rounded(anomaly.volume_statistical(t.dq_runs, marts.max_of(t.events, "ts"), "7d", "volume_zscore"), "confidence", "score")


@query(
    "anom_volume_iqr",
    """
WITH v AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY finished_at DESC, run_id DESC) AS back FROM dq_runs WHERE rows_scanned > 0 AND finished_at >= (SELECT max(ts) FROM events) - INTERVAL 168 HOURS),
s AS (SELECT rule_id, CAST(max(rows_scanned) FILTER (back = 1) AS DOUBLE) AS cur, quantile_cont(CAST(rows_scanned AS DOUBLE), 0.25) FILTER (back > 1) AS q1, quantile_cont(CAST(rows_scanned AS DOUBLE), 0.75) FILTER (back > 1) AS q3, count(*) FILTER (back > 1) AS n FROM v GROUP BY 1)
SELECT rule_id, 'volume_iqr' AS method, cur < q1 - (q3 - q1) * 1.5 OR cur > q3 + (q3 - q1) * 1.5 AS is_anomaly, cur AS actual_value, greatest(0.0, q1 - (q3 - q1) * 1.5) AS expected_min, q3 + (q3 - q1) * 1.5 AS expected_max, n AS history_size FROM s WHERE n >= 5""",
)
def _(t):
    return anomaly.volume_iqr(t.dq_runs, marts.max_of(t.events, "ts"), "7d")


# One run of each rule is planted far off: violations and duration a hundred times the largest.
@query(
    "anom_isolation_forest",
    """
SELECT rule_id, rule_id || '-planted' AS run_id, true AS is_anomaly, true AS among_first FROM dq_runs GROUP BY rule_id
UNION ALL SELECT 'all', 'scored', count(*) + count(DISTINCT rule_id) > 0, true FROM dq_runs""",
)
def _(t):
    far = t.dq_runs.groupBy("rule_id").agg(
        F.max("finished_at").alias("finished_at"), (F.max("violations_count") * 100).alias("violations_count"),
        (F.max("rows_scanned") * 100).alias("rows_scanned"), (F.max("duration_seconds") * 100).alias("duration_seconds"),
    ).withColumn("run_id", F.concat("rule_id", F.lit("-planted")))
    runs = t.dq_runs.unionByName(far, allowMissingColumns=True)
    scored = checkpointed(anomaly.isolation_forest(runs))
    planted = F.col("run_id").endswith("-planted")
    most = scored.where(~planted).agg(F.max("score")).scalar()
    found = scored.where(planted).select("rule_id", "run_id", "is_anomaly", (F.col("score") > most).alias("among_first"))
    # every run has a score, and about the asked share of them is marked
    n = F.count("*")
    whole = scored.agg((F.count("score") == n).alias("is_anomaly"), (F.count_if("is_anomaly") <= 0.06 * n).alias("among_first"))
    return found.unionByName(whole.select(F.lit("all").alias("rule_id"), F.lit("scored").alias("run_id"), "is_anomaly", "among_first"))
