"""Catalogue: windows, sorting, paging, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillwise.functions.columns import dbl, ratio, text
from tillwise.operators import folds, windows
from tillwise.plans.registry import query


@query(
    "win_latest_per_key",
    """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_type, event_id, value FROM x WHERE rn = 1""",
)
def _(t):
    out = windows.latest_per_key(t.events, ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", "value")


@query(
    "win_last_run",
    """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY finished_at DESC) AS rn FROM dq_runs)
SELECT rule_id, run_id, status, violations_count FROM x WHERE rn = 1""",
)
def _(t):
    return windows.latest_per_key(t.dq_runs, ["rule_id"], ["finished_at", "run_id"]).select(
        "rule_id", "run_id", "status", "violations_count"
    )


@query(
    "win_success_rate_last_n",
    """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY finished_at DESC) AS rn FROM dq_runs)
SELECT rule_id, count(*) AS runs, CAST(count(*) FILTER (status = 'SUCCESS') AS DOUBLE) * 100 / count(*) AS success_rate FROM x WHERE rn <= 30 GROUP BY 1""",
)
def _(t):
    return windows.success_rate_last_n(t.dq_runs, 30)


@query(
    "win_recent_purchases",
    """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ts DESC, sale_id DESC) AS rn FROM sales WHERE is_active)
SELECT customer_id, sale_id, CAST(amount AS DOUBLE) AS amount, CAST(rn AS INTEGER) AS rn FROM x WHERE rn <= 5""",
)
def _(t):
    top = windows.top_per_key(t.sales.where("is_active"), ["customer_id"], [F.desc("ts"), F.desc("sale_id")], 5)
    return top.select("customer_id", "sale_id", dbl("amount").alias("amount"), "rn")


@query(
    "win_rank_staff",
    """
WITH r AS (SELECT staff_id, CAST(sum(orders_served) AS DOUBLE) / CAST(sum(hours_worked) AS DOUBLE) AS orders_per_hour FROM shifts GROUP BY 1)
SELECT staff_id, orders_per_hour, rank() OVER (ORDER BY orders_per_hour DESC) AS rank, dense_rank() OVER (ORDER BY orders_per_hour DESC) AS dense_rank FROM r""",
)
def _(t):
    per_staff = t.shifts.groupBy("staff_id").agg(
        ratio(F.sum("orders_served"), F.sum("hours_worked")).alias("orders_per_hour")
    )
    return windows.global_rank(per_staff, "orders_per_hour")


@query(
    "win_brute_force",
    """
WITH f AS (SELECT * FROM audit_events WHERE action IN ('LOGIN_FAILED', 'MFA_FAILED') AND NOT success),
w AS (SELECT event_id, ip, count(*) OVER (PARTITION BY ip ORDER BY ts RANGE BETWEEN INTERVAL 12 HOURS PRECEDING AND CURRENT ROW) AS failed_attempts FROM f)
SELECT event_id, ip, failed_attempts FROM w WHERE failed_attempts >= 5""",
)
def _(t):
    # the generated events are sparse, so the window here is 12 hours
    out = windows.brute_force(t.audit_events, minutes=720)
    return out.select("event_id", "ip", "failed_attempts")


DAILY = """d AS (SELECT branch_id, sale_date, sum(amount) AS v, count(*) AS n FROM sales GROUP BY 1, 2)"""


def daily(t):
    return t.sales.groupBy("branch_id", "sale_date").agg(F.sum("amount").alias("v"), F.count("*").alias("n"))


@query(
    "win_moving_average",
    f"""
WITH {DAILY}
SELECT branch_id, CAST(sale_date AS VARCHAR) AS sale_date, CAST(sum(v) OVER w AS DOUBLE) / count(v) OVER w AS moving_avg FROM d
WINDOW w AS (PARTITION BY branch_id ORDER BY sale_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
)
def _(t):
    out = windows.moving_average(daily(t), ["branch_id"], "sale_date", "v", 7)
    return out.select("branch_id", text("sale_date").alias("sale_date"), "moving_avg")


@query(
    "win_rolling_mean_diff",
    f"""
WITH {DAILY}, m AS (SELECT *, CASE WHEN count(n) OVER w = 7 THEN CAST(sum(n) OVER w AS DOUBLE) / 7 END AS rolling_mean FROM d
  WINDOW w AS (PARTITION BY branch_id ORDER BY sale_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT branch_id, CAST(sale_date AS VARCHAR) AS sale_date, rolling_mean, rolling_mean - lag(rolling_mean) OVER (PARTITION BY branch_id ORDER BY m.sale_date) AS rolling_diff FROM m""",
)
def _(t):
    out = windows.rolling_mean_diff(daily(t), ["branch_id"], "sale_date", "n", 7)
    return out.select("branch_id", text("sale_date").alias("sale_date"), "rolling_mean", "rolling_diff")


@query(
    "win_local_peaks",
    """
WITH m AS (SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, branch_id, count(*) AS n FROM sales GROUP BY 1, 2),
p AS (SELECT *, lag(n) OVER w AS a, lead(n) OVER w AS b FROM m WINDOW w AS (PARTITION BY branch_id ORDER BY month))
SELECT branch_id, CAST(month AS VARCHAR) AS month, n FROM p WHERE n > a AND n > b AND n >= 8""",
)
def _(t):
    months = t.sales.groupBy(F.trunc("sale_date", "month").alias("month"), "branch_id").agg(F.count("*").alias("n"))
    out = windows.local_peaks(months, ["branch_id"], "month", "n", F.lit(8))
    return out.select("branch_id", text("month").alias("month"), "n")


@query(
    "win_last_k_rows",
    """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY finished_at DESC) AS rn FROM dq_runs)
SELECT rule_id, run_id, violations_count, CAST(rn AS INTEGER) AS rn FROM x WHERE rn <= 5""",
)
def _(t):
    top = windows.top_per_key(t.dq_runs, ["rule_id"], [F.desc("finished_at"), F.desc("run_id")], 5)
    return top.select("rule_id", "run_id", "violations_count", "rn")


def lockout_sql(source: str) -> str:
    """Outcomes of login attempts (user_id, event_id, at, ok), row after row."""
    return f"""
WITH RECURSIVE a AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {source} WHERE event_type IN ('error', 'purchase')),
s AS (
  SELECT user_id, event_id, rn, CASE WHEN ok THEN 'accepted' ELSE 'failed' END AS outcome, CASE WHEN ok THEN 0 ELSE 1 END AS failures, CAST(0 AS BIGINT) AS until FROM a WHERE rn = 1
  UNION ALL
  SELECT a.user_id, a.event_id, a.rn,
    CASE WHEN us < until THEN 'refused' WHEN ok THEN 'accepted' WHEN failures + 1 >= {{limit}} THEN 'locked' ELSE 'failed' END,
    CASE WHEN us < until THEN failures WHEN ok THEN 0 ELSE failures + 1 END,
    CASE WHEN us >= until AND NOT ok AND failures + 1 >= {{limit}} THEN us + CAST({{minutes}} AS BIGINT) * 60000000 ELSE until END
  FROM s JOIN a ON a.user_id = s.user_id AND a.rn = s.rn + 1)
SELECT user_id, event_id, outcome, CAST(failures AS INTEGER) AS failures FROM s"""


@query("win_lockout", lockout_sql("events").format(limit=3, minutes=2880))
def _(t):
    # the generated events are sparse, so an account is locked sooner and longer here
    e = t.events.where(F.col("event_type").isin("error", "purchase"))
    return folds.lockout(e, "user_id", "ts", "event_id", F.col("event_type") == "purchase", limit=3, minutes=2880).drop("ts")


@query(
    "win_days_between_visits",
    """
WITH v AS (SELECT DISTINCT customer_id, sale_date FROM sales)
SELECT customer_id, CAST(sale_date AS VARCHAR) AS sale_date, CAST(sale_date - lag(sale_date) OVER (PARTITION BY customer_id ORDER BY v.sale_date) AS INTEGER) AS days_between FROM v""",
)
def _(t):
    visits = t.sales.select("customer_id", "sale_date").distinct()
    prev = F.lag("sale_date").over(Window.partitionBy("customer_id").orderBy("sale_date"))
    return visits.withColumn("days_between", F.datediff("sale_date", prev)).withColumn("sale_date", text("sale_date"))


@query(
    "win_share_of_total",
    """
WITH m AS (SELECT branch_id, payment_method, sum(amount) AS v FROM sales GROUP BY 1, 2)
SELECT branch_id, payment_method, CAST(v AS DOUBLE) AS v, CAST(v AS DOUBLE) * 100 / CAST(sum(v) OVER (PARTITION BY branch_id) AS DOUBLE) AS share FROM m""",
)
def _(t):
    m = t.sales.groupBy("branch_id", "payment_method").agg(F.sum("amount").alias("v"))
    return windows.share_of_total(m, ["branch_id"], "v").withColumn("v", dbl("v"))


@query(
    "win_period_change",
    """
WITH m AS (SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, branch_id, sum(amount) AS v FROM sales GROUP BY 1, 2),
p AS (SELECT *, lag(v) OVER (PARTITION BY branch_id ORDER BY month) AS prev FROM m)
SELECT branch_id, CAST(month AS VARCHAR) AS month, CAST(v AS DOUBLE) AS v, CAST(prev AS DOUBLE) AS previous, CASE WHEN prev <> 0 THEN CAST(v - prev AS DOUBLE) * 100 / CAST(prev AS DOUBLE) END AS change FROM p""",
)
def _(t):
    months = t.sales.groupBy(F.trunc("sale_date", "month").alias("month"), "branch_id").agg(F.sum("amount").alias("v"))
    out = windows.period_change(months, ["branch_id"], "month", "v")
    return out.select("branch_id", text("month").alias("month"), dbl("v").alias("v"), dbl("previous").alias("previous"), "change")


@query(
    "sort_multi",
    "SELECT sale_id, CAST(sale_date AS VARCHAR) AS sale_date, CAST(amount AS DOUBLE) AS amount FROM sales ORDER BY sales.sale_date DESC, sales.amount, sale_id",
)
def _(t):
    out = windows.sort_multi(
        t.sales, ["-sale_date", "amount", "secret", "sale_id"], ["sale_date", "amount", "sale_id"], ["-sale_date", "sale_id"]
    )
    return out.select("sale_id", text("sale_date").alias("sale_date"), dbl("amount").alias("amount"))


@query(
    "page_offset",
    "SELECT sale_id, CAST(amount AS DOUBLE) AS amount FROM sales WHERE is_active ORDER BY ts DESC, sale_id LIMIT 25 OFFSET 50",
)
def _(t):
    out = windows.page(t.sales.where("is_active"), [F.desc("ts"), F.asc("sale_id")], number=3)
    return out.select("sale_id", dbl("amount").alias("amount"))


@query(
    "topk_customers",
    "SELECT customer_id, CAST(total_spent AS DOUBLE) AS total_spent FROM clients WHERE is_active ORDER BY clients.total_spent DESC, customer_id LIMIT 10",
)
def _(t):
    top = t.clients.where("is_active").orderBy(F.desc("total_spent"), "customer_id").limit(10)
    return top.select("customer_id", dbl("total_spent").alias("total_spent"))


@query(
    "topk_users",
    "SELECT user_id, count(*) AS n FROM audit_events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
)
def _(t):
    return t.audit_events.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query(
    "topk_series",
    """
WITH s AS (SELECT branch_id, sum(amount) FILTER (payment_method = 'cash') AS cash, sum(amount) FILTER (payment_method = 'card') AS card FROM sales GROUP BY 1)
SELECT branch_id, CAST(cash AS DOUBLE) AS cash, CAST(card AS DOUBLE) AS card FROM s ORDER BY coalesce(s.cash, 0) DESC, branch_id LIMIT 8""",
)
def _(t):
    s = t.sales.groupBy("branch_id").agg(
        *[F.sum(F.when(F.col("payment_method") == m, F.col("amount"))).alias(m) for m in ("cash", "card")]
    )
    top = s.orderBy(F.coalesce("cash", F.lit(0)).desc(), "branch_id").limit(8)
    return top.select("branch_id", dbl("cash").alias("cash"), dbl("card").alias("card"))


@query(
    "topk_with_other",
    """
WITH s AS (SELECT brand, count(*) AS v FROM stock GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, brand) AS rn FROM s)
SELECT brand, v, CAST(0 AS BIGINT) AS grouped FROM r WHERE rn <= 6 UNION ALL SELECT 'Other', CAST(sum(v) AS BIGINT), count(*) FROM r WHERE rn > 6 HAVING sum(v) > 0""",
)
def _(t):
    s = t.stock.groupBy("brand").agg(F.count("*").alias("v"))
    return windows.top_with_other(s, "brand", "v", 6)


@query(
    "sample_rows",
    "SELECT event_id, event_type FROM events WHERE CAST('0x' || left(md5(CAST(event_id AS VARCHAR)), 8) AS BIGINT) % 100 < 10",
)
def _(t):
    return windows.sample_rows(t.events, F.col("event_id"), 100, 10).select("event_id", "event_type")
