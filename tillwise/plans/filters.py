"""Catalogue: list filters, search and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.columns import dbl, text
from tillwise.operators import filters, marts
from tillwise.plans.marts import RULES_SQL, rules_of
from tillwise.plans.registry import query


@query(
    "filter_branch",
    """
SELECT n_nationkey AS branch_id, n_name AS branch_name, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE lower(n_name) LIKE '%nation_1%' AND lower(r_name) LIKE '%a%' AND n_nationkey < 20""",
)
def _(t):
    b = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("branch_id"),
        F.col("n_name").alias("branch_name"),
        F.col("r_name").alias("country"),
        (F.col("n_nationkey") < 20).alias("is_active"),
    )
    return filters.by_fields(b, filters.BRANCH, name="Nation_1", country="A", is_active=True).drop("is_active")


@query(
    "filter_sales",
    """
SELECT sale_id, CAST(amount AS DOUBLE) AS amount FROM sales JOIN nation ON branch_id = n_nationkey
WHERE lower(n_name) LIKE '%nation_2%' AND sale_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND payment_method = 'card' AND order_type = 'dine_in'
  AND amount >= 50000 AND is_active""",
)
def _(t):
    s = t.sales.join(t.nation.select(F.col("n_nationkey").alias("branch_id"), F.col("n_name").alias("branch_name")), "branch_id")
    out = filters.by_fields(
        s, filters.SALES, branch_name="nation_2", date=(F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("1999-12-31"))),
        payment_method="card", order_type="dine_in", amount=(50000, None), is_active=True,
    )
    return out.select("sale_id", dbl("amount").alias("amount"))


@query(
    "filter_inventory",
    """
SELECT product_id, stock_quantity FROM stock WHERE lower(item_name) LIKE '%ring%' AND stock_quantity <= reorder_level
  AND expiry_date < (SELECT max(sale_date) FROM sales) AND expiry_date <= DATE '2001-12-31' AND is_active""",
)
def _(t):
    today = t.last_sale_day
    out = filters.by_fields(t.stock, filters.INVENTORY, item_name="RING", expiry=(None, F.to_date(F.lit("2001-12-31"))), is_active=True)
    return out.where(filters.low_stock() & filters.expired(today)).select("product_id", "stock_quantity")


@query(
    "filter_customer",
    """
SELECT customer_id, name FROM clients WHERE lower(name) LIKE '%customer#00000%' AND loyalty_points >= 100 AND total_spent BETWEEN 500 AND 5000
  AND visit_count >= 5 AND last_visit >= DATE '2001-01-01'""",
)
def _(t):
    return filters.by_fields(
        t.clients, filters.CUSTOMER, name="customer#00000", points=(100, None), spent=(500, 5000), visits=(5, None),
        last_visit=(F.to_date(F.lit("2001-01-01")), None),
    ).select("customer_id", "name")


@query(
    "filter_staff_performance",
    """
SELECT staff_id, CAST(shift_date AS VARCHAR) AS shift_date FROM shifts WHERE branch_id = 3 AND shift_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'
  AND hours_worked >= 6 AND sales_generated >= 20000 AND feedback BETWEEN 1 AND 5""",
)
def _(t):
    out = filters.by_fields(
        t.shifts, filters.STAFF, branch=3, date=(F.to_date(F.lit("1998-01-01")), F.to_date(F.lit("1999-12-31"))),
        hours=(6, None), sales=(20000, None), feedback=(1, 5),
    )
    return out.select("staff_id", text("shift_date").alias("shift_date"))


@query("filter_dq", f"WITH {RULES_SQL} SELECT rule_id, severity FROM rules WHERE check_type = 'PROMO' AND severity IN ('HIGH', 'CRITICAL') AND enabled")
def _(t):
    return filters.by_fields(rules_of(t), filters.DQ_RULE, check_type="PROMO", severity=["HIGH", "CRITICAL"], enabled=True).select("rule_id", "severity")


@query(
    "filter_audit",
    """
SELECT event_id, CAST(ts AS VARCHAR) AS ts FROM audit_events WHERE severity = 'HIGH' AND NOT success AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
ORDER BY audit_events.ts DESC, event_id DESC LIMIT 100""",
)
def _(t):
    hits = filters.by_fields(
        t.audit_events, filters.AUDIT, severity="HIGH", success=False,
        time=(F.to_timestamp(F.lit("2024-01-05")), F.to_timestamp(F.lit("2024-01-20"))),
    )
    return filters.newest(hits, "ts", "event_id", 100).select("event_id", text("ts").alias("ts"))


@query(
    "filter_logs",
    "SELECT event_id, status FROM log_entries WHERE user_id = 'u7' AND ip = '10.0.0.2' AND action = 'login' AND ts > TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-02'",
)
def _(t):
    hits = filters.by_fields(t.log_entries, filters.LOG, user="u7", ip="10.0.0.2", action="login")
    return hits.where(filters.log_time_range("ts", "2024-01-01,2024-01-01")).select("event_id", "status")


@query(
    "filter_log_time_range",
    """
SELECT event_id, 'range' AS spec FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'
UNION ALL SELECT event_id, 'invalid' FROM events""",
)
def _(t):
    a = t.events.where(filters.log_time_range("ts", "2024-01-10,2024-01-12")).select("event_id", F.lit("range").alias("spec"))
    b = t.events.where(filters.log_time_range("ts", "invalid-range")).select("event_id", F.lit("invalid").alias("spec"))
    return a.unionAll(b)


@query(
    "search_multi",
    "SELECT product_id, item_name FROM stock WHERE lower(item_name) LIKE '%promo%' OR lower(category) LIKE '%promo%' OR lower(brand) LIKE '%promo%'",
)
def _(t):
    return filters.search(t.stock, ["item_name", "category", "brand"], "Promo").select("product_id", "item_name")


@query(
    "filter_soft_delete",
    """
SELECT product_id, is_active AND NOT (category = 'SMALL') AS is_active,
  CASE WHEN category = 'SMALL' AND is_active THEN CAST((SELECT max(sale_date) FROM sales) AS VARCHAR) END AS updated_at FROM stock""",
)
def _(t):
    out = filters.soft_delete(t.stock, F.col("category") == "SMALL", t.last_sale_day)
    return out.select("product_id", "is_active", text("updated_at").alias("updated_at"))


@query(
    "filter_period",
    """
WITH a AS (SELECT max(sale_date) AS d FROM sales), x AS (SELECT sale_date AS s, d FROM sales, a)
SELECT 'last_7_days' AS period, count(*) AS n FROM x WHERE s BETWEEN d - 7 AND d UNION ALL SELECT 'last_30_days', count(*) FROM x WHERE s BETWEEN d - 30 AND d
UNION ALL SELECT 'last_90_days', count(*) FROM x WHERE s BETWEEN d - 90 AND d UNION ALL SELECT 'this_month', count(*) FROM x WHERE s BETWEEN date_trunc('month', d) AND d
UNION ALL SELECT 'last_month', count(*) FROM x WHERE s >= date_trunc('month', d) - INTERVAL 1 MONTH AND s < date_trunc('month', d)
UNION ALL SELECT 'this_year', count(*) FROM x WHERE s BETWEEN date_trunc('year', d) AND d""",
)
def _(t):
    as_of = t.last_sale_day
    flags = t.sales.agg(*[F.count_if(filters.in_period("sale_date", p, as_of)).alias(p) for p in filters.PERIODS])
    return flags.unpivot([], list(filters.PERIODS), "period", "n")


@query(
    "filter_user",
    "SELECT s_suppkey AS user_id, count(*) OVER () AS total FROM supplier WHERE s_nationkey < 12 AND s_acctbal >= 0 AND s_suppkey % 4 = 1",
)
def _(t):
    users = t.supplier.select(
        F.col("s_suppkey").alias("user_id"),
        (F.col("s_nationkey") < 12).alias("branch_id"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
        F.when(F.col("s_suppkey") % 4 == 1, "manager").otherwise("staff").alias("role"),
    )
    hits = filters.by_fields(users, filters.USER, role="manager", branch=True, is_active=True)
    total = hits.agg(F.count("*").alias("n")).scalar()
    return hits.orderBy(F.desc("user_id")).select("user_id", total.alias("total"))


@query(
    "filter_customer_segment",
    """
SELECT customer_id, CASE WHEN total_spent >= 1000 THEN 'gold' WHEN total_spent >= 500 THEN 'silver' ELSE 'standard' END AS segment, visit_count >= 10 AS frequent FROM clients""",
)
def _(t):
    return t.clients.select("customer_id", filters.segment().alias("segment"), (F.col("visit_count") >= 10).alias("frequent"))


@query(
    "filter_rule_history",
    "SELECT run_id, violations_count FROM dq_runs WHERE rule_id = 'view' AND finished_at >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS ORDER BY finished_at DESC LIMIT 100",
)
def _(t):
    runs = t.dq_runs.where((F.col("rule_id") == "view") & (F.col("finished_at") >= marts.max_of(t.events, "ts") - F.expr("INTERVAL 7 DAYS")))
    return filters.newest(runs, "finished_at", "run_id", 100).select("run_id", "violations_count")


PATTERN_SQL = r"(union\s+select|script\s*>|javascript:|vbscript:)|(\.\./|\.\.\\)|(<script|<iframe|<object)|(eval\s*\(|expression\s*\()"


@query(
    "filter_suspicious_request",
    f"""
WITH x AS (SELECT page_id, regexp_matches(url, '{PATTERN_SQL}', 'i') AS a, regexp_matches('html=' || html, '{PATTERN_SQL}', 'i') AS b FROM pages)
SELECT page_id, concat_ws(',', CASE WHEN a THEN 'path' END, CASE WHEN b THEN 'post_param:html' END) AS locations FROM x WHERE a OR b""",
)
def _(t):
    hits = filters.suspicious_locations({"path": F.col("url"), "post_param:html": F.concat(F.lit("html="), F.col("html"))})
    return t.pages.select("page_id", hits.alias("h")).where(F.size("h") > 0).select("page_id", F.array_join("h", ",").alias("locations"))
