"""Catalogue: time series, cohorts and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions import prefix
from tillwise.functions.columns import text
from tillwise.operators import marts, series
from tillwise.plans.registry import query
from tillwise.plans.standins import MONEY
from tillwise.sources import calendar


@query(
    "ts_bucket_agg",
    """
WITH e AS (SELECT event_type, event_id, ts, CAST(value AS DECIMAL(18,2)) AS v FROM events),
g AS (SELECT 'hour' AS step, event_type, date_trunc('hour', ts) AS b, event_id, ts, v FROM e UNION ALL SELECT 'week', event_type, CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS TIMESTAMP), event_id, ts, v FROM e UNION ALL SELECT 'month', event_type, CAST(date_trunc('month', ts) AS TIMESTAMP), event_id, ts, v FROM e)
SELECT step, event_type, CAST(b AS VARCHAR) AS bucket, CAST(sum(v) AS DOUBLE) AS sum, CAST(sum(v) AS DOUBLE) / count(v) AS avg, CAST(max(v) AS DOUBLE) AS max, CAST(min(v) AS DOUBLE) AS min, count(v) AS count,
  CAST(min_by(v, ts) AS DOUBLE) AS first, count(*) AS n FROM g GROUP BY 1, 2, 3""",
)
def _(t):
    e = t.events.select("event_type", "event_id", "ts", F.col("value").cast(MONEY).alias("v"))
    out = series.bucket_aggs(e, "ts", "v", F.struct("ts", "event_id"), ("hour", "week", "month"), ("sum", "avg", "max", "min", "count", "first"), ["event_type"])
    return out.withColumn("bucket", text("bucket"))


# The plain algorithm: from the point chosen last, the largest triangle with the mean of the next bucket.
LTTB_SQL = """
WITH RECURSIVE p AS (
  SELECT event_type AS s, event_id, epoch_us(ts) / 1e6 AS x, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS total FROM events),
b AS (SELECT *, CASE WHEN total <= {n} THEN i WHEN i = 0 THEN -1 WHEN i = total - 1 THEN {n} - 2 ELSE least(CAST(floor((i - 1) / ((total - 2) / CAST({n} - 2 AS DOUBLE))) AS BIGINT), {n} - 3) END AS b FROM p),
m AS (SELECT s, b, sum(x) / count(*) AS mx, sum(y) / count(*) AS my FROM b GROUP BY s, b),
c AS (
  SELECT s, b, i, x, y FROM b WHERE i = 0 AND total > {n}
  UNION ALL
  SELECT s, b, i, x, y FROM (
    SELECT b.s, b.b, b.i, b.x, b.y, row_number() OVER (PARTITION BY b.s ORDER BY abs((c.x - m.mx) * (b.y - c.y) - (c.x - b.x) * (m.my - c.y)) DESC NULLS LAST, b.i) AS rn
    FROM c JOIN b ON b.s = c.s AND b.b = c.b + 1 LEFT JOIN m ON m.s = c.s AND m.b = c.b + 2) WHERE rn = 1)
SELECT s AS event_type, i, x, y FROM c UNION ALL SELECT s, i, x, y FROM b WHERE total <= {n}"""


@query("ts_downsample_lttb", LTTB_SQL.format(n=200))
def _(t):
    e = t.events.select("event_type", "event_id", (F.unix_micros("ts") / 1e6).alias("x"), "value")
    return series.lttb(e, "event_type", "x", "value", 200, "event_id")


@query(
    "ts_outliers_iqr",
    """
WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events),
q AS (SELECT max(value) FILTER (i = CAST(floor(n * 0.25) AS BIGINT)) AS q1, max(value) FILTER (i = CAST(floor(n * 0.75) AS BIGINT)) AS q3 FROM r)
SELECT event_id, value FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def _(t):
    return series.outliers_iqr(t.events, "value").select("event_id", "value")


@query(
    "ts_gap_fill",
    """
WITH b AS (SELECT event_type, date_trunc('hour', ts) AS bucket, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT DISTINCT event_type FROM events),
a AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), max(ts), INTERVAL 1 HOUR)) AS bucket FROM events)
SELECT k.event_type, CAST(a.bucket AS VARCHAR) AS bucket, coalesce(n, 0) AS n FROM k CROSS JOIN a LEFT JOIN b ON b.event_type = k.event_type AND b.bucket = a.bucket""",
)
def _(t):
    counts = t.events.groupBy("event_type", series.bucket_of("ts", "hour").alias("bucket")).agg(F.count("*").alias("n"))
    axis = calendar.axis_of(t.events, "ts", "hour").withColumnRenamed("t", "bucket")
    out = series.fill_gaps(counts, axis, t.events.select("event_type").distinct(), "bucket", {"n": 0})
    return out.withColumn("bucket", text("bucket"))


@query(
    "cohort_retention",
    """
WITH m AS (SELECT DISTINCT customer_id, CAST(date_trunc('month', sale_date) AS DATE) AS m FROM sales), f AS (SELECT customer_id, min(m) AS cohort FROM m GROUP BY 1),
c AS (SELECT cohort, CAST((year(m) - year(cohort)) * 12 + month(m) - month(cohort) AS INTEGER) AS period, count(*) AS active FROM m JOIN f USING (customer_id) GROUP BY 1, 2)
SELECT CAST(cohort AS VARCHAR) AS cohort, period, active, max(active) FILTER (period = 0) OVER (PARTITION BY c.cohort) AS cohort_size, CAST(active AS DOUBLE) / max(active) FILTER (period = 0) OVER (PARTITION BY c.cohort) AS retention FROM c""",
)
def _(t):
    return series.cohort_retention(t.sales, "customer_id", "sale_date").withColumn("cohort", text("cohort"))


# Counters per rule that restart every day.
COUNTER_SQL = """counters AS (SELECT rule_id, finished_at AS ts, CAST(sum(violations_count) OVER (PARTITION BY rule_id, CAST(finished_at AS DATE) ORDER BY finished_at) AS BIGINT) AS value FROM dq_runs)"""


def counters(t):
    runs = t.dq_runs.select("rule_id", "run_id", F.col("finished_at").alias("ts"), F.to_date("finished_at").alias("day"), "violations_count")
    return prefix.running(runs, ["rule_id", "day"], ["ts", "run_id"], {"value": F.col("violations_count")}).select("rule_id", "ts", "value")


INCREASE_SQL = f"""WITH {COUNTER_SQL}, r AS (SELECT * FROM counters WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 72 HOURS), s AS (SELECT *, lag(value) OVER (PARTITION BY rule_id ORDER BY ts) AS p FROM r),
i AS (SELECT rule_id, CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END) AS BIGINT) AS increase FROM s GROUP BY 1)"""


@query("prom_increase", f"{INCREASE_SQL} SELECT rule_id, increase FROM i")
def _(t):
    return series.increase(counters(t), ["rule_id"], "ts", "value", marts.max_of(t.events, "ts"), "72 HOURS")


@query("prom_rate", f"{INCREASE_SQL} SELECT rule_id, CAST(increase AS DOUBLE) / 259200 AS rate FROM i")
def _(t):
    return series.rate(counters(t), ["rule_id"], "ts", "value", marts.max_of(t.events, "ts"), "72 HOURS", 259200)


@query("prom_topk", "SELECT user_id, count(*) AS value FROM audit_events GROUP BY 1 ORDER BY value DESC, user_id LIMIT 10")
def _(t):
    return series.topk(t.audit_events.groupBy("user_id").agg(F.count("*").alias("value")), 10, "value", "user_id")


@query("prom_sum_by", "SELECT rule_id, status, CAST(sum(violations_count) AS DOUBLE) AS value FROM dq_runs GROUP BY 1, 2")
def _(t):
    return series.sum_by(t.dq_runs, ["rule_id", "status"], "violations_count")


@query("prom_avg_by", "SELECT rule_id, CAST(sum(violations_count) AS DOUBLE) / count(*) AS value FROM dq_runs GROUP BY 1")
def _(t):
    return series.avg_by(t.dq_runs, ["rule_id"], "violations_count")


@query("prom_ratio", "SELECT rule_id, CAST(count(*) FILTER (status = 'SUCCESS') AS DOUBLE) / count(*) AS ratio, CAST(count(*) FILTER (status = 'SUCCESS') AS DOUBLE) / count(*) < 0.55 AS firing FROM dq_runs GROUP BY 1")
def _(t):
    return series.success_ratio(t.dq_runs, ["rule_id"], 0.55)


@query(
    "prom_quantile",
    "SELECT rule_id, quantile_cont(CAST(rows_scanned AS DOUBLE), 0.5) AS p50, round(quantile_cont(CAST(rows_scanned AS DOUBLE), 0.95), 9) AS p95 FROM dq_runs GROUP BY 1",
)
def _(t):
    return series.quantiles(t.dq_runs, ["rule_id"], "rows_scanned").withColumn("p95", F.round("p95", 9))


@query(
    "alert_threshold_for",
    """
WITH m AS (SELECT *, violations_count * 2 > rows_scanned AS on_ FROM dq_runs), g AS (SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY rule_id ORDER BY finished_at) AS g FROM m),
s AS (SELECT rule_id, g, min(finished_at) AS a, max(finished_at) AS b, count(*) AS n FROM g WHERE on_ GROUP BY 1, 2)
SELECT rule_id, CAST(a AS VARCHAR) AS started, CAST(b AS VARCHAR) AS ended, n AS samples FROM s WHERE epoch(b) - epoch(a) >= 10800""",
)
def _(t):
    out = series.firing_for(t.dq_runs, ["rule_id"], "finished_at", F.col("violations_count") * 2 > F.col("rows_scanned"), 10800)
    return out.select("rule_id", text("started").alias("started"), text("ended").alias("ended"), "samples")
