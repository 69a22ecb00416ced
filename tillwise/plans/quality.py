"""Catalogue: data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.columns import text
from tillwise.operators import marts, quality
from tillwise.plans.registry import query
from tillwise.plans.standins import MONEY

# Lines with some values missing and some duplicated transaction numbers.
DQ_SQL = """dq AS (SELECT CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS total_amount, l_orderkey * 10 + l_linenumber AS transaction_id,
  l_discount AS discount, l_returnflag AS category, CASE WHEN l_suppkey % 30 <> 0 THEN l_partkey END AS product_id, l_shipdate AS created_at, l_quantity AS quantity FROM lineitem)"""


def dq(t):
    return t.lineitem.select(
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_extendedprice").cast(MONEY)).alias("total_amount"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
        F.col("l_discount").alias("discount"),
        F.col("l_returnflag").alias("category"),
        F.when(F.col("l_suppkey") % 30 != 0, F.col("l_partkey")).alias("product_id"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_quantity").alias("quantity"),
    )


RULES = [
    {"name": "rows", "check_type": "row_count", "threshold": 1000, "severity": "CRITICAL"},
    {"name": "rows_between", "check_type": "row_count", "threshold": 0, "params": {"min_rows": 10, "max_rows": 500}, "severity": "HIGH"},
    {"name": "amount_nulls", "check_type": "null_rate", "column": "total_amount", "threshold": 0.01, "severity": "CRITICAL"},
    {"name": "product_nulls", "check_type": "null_rate", "column": "product_id", "threshold": 0.05, "severity": "HIGH"},
    {"name": "transaction_unique", "check_type": "uniqueness", "column": "transaction_id", "threshold": 0, "severity": "CRITICAL"},
    {"name": "transaction_rate", "check_type": "uniqueness", "column": "transaction_id", "threshold": 0, "params": {"min_uniqueness_rate": 0.98}, "severity": "LOW"},
    {"name": "amount_range", "check_type": "range_check", "column": "total_amount", "threshold": 0.02, "params": {"min_value": 1000, "max_value": 80000}, "severity": "MEDIUM"},
    {"name": "discount_range", "check_type": "range_check", "column": "discount", "threshold": 0, "params": {"max_value": 0.1}, "severity": "MEDIUM"},
    {"name": "categories", "check_type": "cardinality", "column": "category", "threshold": 5, "severity": "WARN"},
    {"name": "fresh", "check_type": "timeliness", "column": "created_at", "threshold": 86400, "params": {"grace_seconds": 3600}, "severity": "HIGH"},
]
VERDICTS = {
    "rows": "SELECT 'row_count' AS check_type, count(*) AS rows_scanned, CASE WHEN count(*) >= 1000 THEN 0 ELSE 1 END AS violations_count, CAST(count(*) AS DOUBLE) AS metric_value, 1000.0 AS threshold, count(*) >= 1000 AS passed, 'CRITICAL' AS severity FROM dq",
    "rows_between": "SELECT 'row_count', count(*), CASE WHEN count(*) BETWEEN 10 AND 500 THEN 0 ELSE 1 END, CAST(count(*) AS DOUBLE), 0.0, count(*) BETWEEN 10 AND 500, 'HIGH' FROM dq",
    "amount_nulls": "SELECT 'null_rate', count(*), count(*) - count(total_amount), CAST(count(*) - count(total_amount) AS DOUBLE) / count(*), 0.01, CAST(count(*) - count(total_amount) AS DOUBLE) / count(*) <= 0.01, 'CRITICAL' FROM dq",
    "product_nulls": "SELECT 'null_rate', count(*), count(*) - count(product_id), CAST(count(*) - count(product_id) AS DOUBLE) / count(*), 0.05, CAST(count(*) - count(product_id) AS DOUBLE) / count(*) <= 0.05, 'HIGH' FROM dq",
    "transaction_unique": "SELECT 'uniqueness', count(*), count(*) - count(DISTINCT transaction_id), CAST(count(*) - count(DISTINCT transaction_id) AS DOUBLE), 0.0, count(*) = count(DISTINCT transaction_id), 'CRITICAL' FROM dq",
    "transaction_rate": "SELECT 'uniqueness', count(*), count(*) - count(DISTINCT transaction_id), CAST(count(DISTINCT transaction_id) AS DOUBLE) / count(*), 0.0, CAST(count(DISTINCT transaction_id) AS DOUBLE) / count(*) >= 0.98, 'LOW' FROM dq",
    "amount_range": "SELECT 'range_check', count(total_amount), count(*) FILTER (total_amount < 1000 OR total_amount > 80000), CAST(count(*) FILTER (total_amount < 1000 OR total_amount > 80000) AS DOUBLE) / count(total_amount), 0.02, CAST(count(*) FILTER (total_amount < 1000 OR total_amount > 80000) AS DOUBLE) / count(total_amount) <= 0.02, 'MEDIUM' FROM dq",
    "discount_range": "SELECT 'range_check', count(discount), count(*) FILTER (discount > 0.1::DOUBLE), CAST(count(*) FILTER (discount > 0.1::DOUBLE) AS DOUBLE) / count(discount), 0.0, count(*) FILTER (discount > 0.1::DOUBLE) = 0, 'MEDIUM' FROM dq",
    "categories": "SELECT 'cardinality', count(*), CASE WHEN count(DISTINCT category) <= 5 THEN 0 ELSE 1 END, CAST(count(DISTINCT category) AS DOUBLE), 5.0, count(DISTINCT category) <= 5, 'WARN' FROM dq",
    "fresh": "SELECT 'timeliness', count(*), CASE WHEN epoch(TIMESTAMP '2001-11-06' - max(created_at)) <= 90000 THEN 0 ELSE 1 END, epoch(TIMESTAMP '2001-11-06' - max(created_at)), 86400.0, epoch(TIMESTAMP '2001-11-06' - max(created_at)) <= 90000, 'HIGH' FROM dq",
}
NAMES = "rule, check_type, rows_scanned, violations_count, metric_value, threshold, passed, severity"


def verdict_sql(names: list[str]) -> str:
    parts = [f"SELECT '{n}', * FROM ({VERDICTS[n]})" for n in names]
    return f"WITH {DQ_SQL}, v({NAMES}) AS (" + " UNION ALL ".join(parts) + ") SELECT rule, check_type, rows_scanned, CAST(violations_count AS BIGINT) AS violations_count, metric_value, CAST(threshold AS DOUBLE) AS threshold, passed, severity FROM v"


def rule_query(qid: str, names: list[str]):
    @query(qid, verdict_sql(names))
    def _(t):
        picked = quality.select_rules(RULES, names=names)
        return quality.run_rules(dq(t), picked, F.to_timestamp(F.lit("2001-11-06")))


rule_query("dq_row_count", ["rows", "rows_between"])
rule_query("dq_null_rate", ["amount_nulls", "product_nulls"])
rule_query("dq_uniqueness", ["transaction_unique", "transaction_rate"])
rule_query("dq_range", ["amount_range", "discount_range"])
rule_query("dq_cardinality", ["categories"])
rule_query("dq_timeliness", ["fresh"])
rule_query("dq_rule_set", [r["name"] for r in RULES])


@query(
    "dq_ref_integrity",
    f"""WITH {DQ_SQL}, o AS (SELECT count(product_id) AS n, count(*) FILTER (product_id IS NOT NULL AND product_id NOT IN (SELECT product_id FROM stock WHERE is_active)) AS bad FROM dq)
SELECT 'products_exist' AS rule, n AS rows_scanned, bad AS violations_count, CAST(bad AS DOUBLE) / n AS metric_value, CAST(bad AS DOUBLE) / n <= 0.01 AS passed FROM o""",
)
def _(t):
    rule = {"name": "products_exist", "column": "product_id", "threshold": 0.01, "params": {"ref_table": "stock", "ref_column": "part_id"}}
    parent = t.stock.where("is_active").select(F.col("product_id").alias("part_id"))
    return quality.ref_integrity(rule, dq(t), parent)


@query(
    "dq_schema_drift",
    """
SELECT 'k' AS field, 'bigint' AS type, 'string' AS expected, 'retyped' AS change, count(*) AS rows FROM events
UNION ALL SELECT 'note', NULL, 'string', 'removed', 0 UNION ALL SELECT 'u', 'bigint', NULL, 'added', count(*) FROM events WHERE user_id % 2 = 0""",
)
def _(t):
    payload = F.when(F.col("user_id") % 2 == 0, F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "u": '), text("user_id"), F.lit("}"))).otherwise(F.col("props"))
    return quality.payload_drift(t.events.withColumn("p", payload), "p", {"k": "string", "note": "string"})


@query(
    "dq_volume_anomaly",
    """
WITH v AS (SELECT date_trunc('day', ts) AS b, count(*) AS n FROM events GROUP BY 1), x AS (SELECT (SELECT n FROM v ORDER BY b DESC LIMIT 1) AS cur, CAST(sum(n) AS DOUBLE) / count(*) AS exp FROM v WHERE b < (SELECT max(b) FROM v))
SELECT cur AS current_volume, exp AS expected_volume, abs(cur - exp) / exp AS deviation, abs(cur - exp) / exp <= 0.3 AS passed FROM x""",
)
def _(t):
    return quality.volume_anomaly(quality.volume(t.events, "ts", "day"))


@query("dq_custom_query", "SELECT branch_id, count(*) AS bad_sales FROM sales WHERE amount < 20000 AND payment_method = 'voucher' GROUP BY 1")
def _(t):
    return quality.custom_query(
        t.spark, {"s": t.sales}, "SELECT branch_id, count(*) AS bad_sales FROM {s} WHERE amount < 20000 AND payment_method = 'voucher' GROUP BY branch_id"
    )


@query(
    "dq_suggest",
    f"""WITH {DQ_SQL}, n AS (SELECT count(*) - count(total_amount) AS a, count(*) - count(transaction_id) AS b, count(*) - count(discount) AS c, count(*) - count(category) AS d, count(*) - count(product_id) AS e,
  count(*) - count(created_at) AS f, count(*) - count(quantity) AS g, min(total_amount) AS ma, min(transaction_id) AS mb, min(discount) AS mc, min(product_id) AS me, min(quantity) AS mg FROM dq),
s(name, check_type, "column", threshold, severity, keep) AS (
SELECT 'sales_row_count_check', 'row_count', NULL, 1.0, 'CRITICAL', true UNION ALL SELECT 'sales_primary_key_uniqueness', 'uniqueness', 'transaction_id', 0.0, 'CRITICAL', true
UNION ALL SELECT 'sales_total_amount_not_null', 'null_rate', 'total_amount', 0.01, 'CRITICAL', true UNION ALL SELECT 'sales_positive_amounts', 'range_check', 'total_amount', 0.0, 'CRITICAL', true
UNION ALL SELECT 'sales_total_amount_not_null', 'null_rate', 'total_amount', 0.0, 'MEDIUM', a = 0 FROM n UNION ALL SELECT 'sales_transaction_id_not_null', 'null_rate', 'transaction_id', 0.0, 'MEDIUM', b = 0 FROM n
UNION ALL SELECT 'sales_discount_not_null', 'null_rate', 'discount', 0.0, 'MEDIUM', c = 0 FROM n UNION ALL SELECT 'sales_category_not_null', 'null_rate', 'category', 0.0, 'MEDIUM', d = 0 FROM n
UNION ALL SELECT 'sales_product_id_not_null', 'null_rate', 'product_id', 0.0, 'MEDIUM', e = 0 FROM n UNION ALL SELECT 'sales_created_at_not_null', 'null_rate', 'created_at', 0.0, 'MEDIUM', f = 0 FROM n
UNION ALL SELECT 'sales_quantity_not_null', 'null_rate', 'quantity', 0.0, 'MEDIUM', g = 0 FROM n UNION ALL SELECT 'sales_total_amount_not_negative', 'range_check', 'total_amount', 0.0, 'MEDIUM', ma >= 0 FROM n
UNION ALL SELECT 'sales_transaction_id_not_negative', 'range_check', 'transaction_id', 0.0, 'MEDIUM', mb >= 0 FROM n UNION ALL SELECT 'sales_discount_not_negative', 'range_check', 'discount', 0.0, 'MEDIUM', mc >= 0 FROM n
UNION ALL SELECT 'sales_product_id_not_negative', 'range_check', 'product_id', 0.0, 'MEDIUM', me >= 0 FROM n UNION ALL SELECT 'sales_quantity_not_negative', 'range_check', 'quantity', 0.0, 'MEDIUM', mg >= 0 FROM n)
SELECT name, check_type, "column", CAST(threshold AS DOUBLE) AS threshold, severity FROM s WHERE keep""",
)
def _(t):
    return quality.suggest(dq(t), "sales", "transaction_id")


@query(
    "dq_violation_rows",
    """
WITH b AS (SELECT 'small' AS rule, o_orderkey FROM orders WHERE o_totalprice < 5000 UNION ALL SELECT 'large', o_orderkey FROM orders WHERE o_totalprice > 490000),
r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY o_orderkey) AS rn FROM b)
SELECT rule, '{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"o_orderstatus":"' || o_orderstatus || '"}' AS record FROM r JOIN orders USING (o_orderkey) WHERE rn <= 100""",
)
def _(t):
    small, large = F.col("o_totalprice") < 5000, F.col("o_totalprice") > 490000
    flagged = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = quality.violation_rows(flagged, [("small", small), ("large", large)], ["o_orderkey"], 100)
    slim = F.from_json("record", "o_orderkey long, o_orderstatus string")
    return out.select("rule", F.to_json(slim).alias("record"))


METRICS_SQL = """metrics AS (SELECT rule_id, finished_at, unnest(['duration', 'violations', 'rows_scanned', 'pass_rate']) AS metric_name,
  unnest([duration_seconds, CAST(violations_count AS DOUBLE), CAST(rows_scanned AS DOUBLE), CAST(rows_scanned - violations_count AS DOUBLE) * 100 / rows_scanned]) AS value FROM dq_runs)"""


@query("dq_metrics_rows", f"WITH {METRICS_SQL} SELECT rule_id, CAST(finished_at AS VARCHAR) AS finished_at, metric_name, value FROM metrics")
def _(t):
    return quality.metric_rows(t.dq_runs).withColumn("finished_at", text("finished_at"))


@query(
    "dq_acknowledge",
    """
SELECT event_id, k % 10 = 0 OR severity = 'HIGH' AS acknowledged, CASE WHEN severity = 'HIGH' AND k % 10 <> 0 THEN 'ana' END AS acknowledged_by,
  (SELECT count(*) FROM audit_events WHERE severity = 'HIGH' AND k % 10 <> 0) AS acknowledged_count FROM audit_events""",
)
def _(t):
    v = t.audit_events.select(
        "event_id", "severity", (F.col("k") % 10 == 0).alias("acknowledged"),
        F.lit(None).cast("string").alias("acknowledged_by"), F.lit(None).cast("timestamp").alias("acknowledged_at"),
    )
    out, n = quality.acknowledge(v, F.col("severity") == "HIGH", "ana", F.current_timestamp())
    return out.select("event_id", "acknowledged", "acknowledged_by", n.scalar().alias("acknowledged_count"))


@query(
    "dq_metric_series",
    f"WITH {METRICS_SQL} SELECT rule_id, CAST(finished_at AS VARCHAR) AS finished_at, value FROM metrics WHERE metric_name = 'pass_rate' AND rule_id IN ('view', 'click') AND metrics.finished_at >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS",
)
def _(t):
    m = quality.metric_rows(t.dq_runs).where(
        (F.col("metric_name") == "pass_rate") & F.col("rule_id").isin("view", "click") & (F.col("finished_at") >= marts.max_of(t.events, "ts") - F.expr("INTERVAL 7 DAYS"))
    )
    return m.orderBy("rule_id", "finished_at").select("rule_id", text("finished_at").alias("finished_at"), "value")


@query(
    "dq_alert_routing",
    """
WITH a AS (SELECT event_id, severity, resource_type, unnest(CASE severity WHEN 'CRITICAL' THEN ['email', 'slack', 'pagerduty'] WHEN 'HIGH' THEN ['email', 'slack'] WHEN 'MEDIUM' THEN ['email'] ELSE ['slack'] END) AS channel FROM audit_events WHERE NOT success)
SELECT 'dq-' || resource_type || '-' || CAST(event_id AS VARCHAR) AS dedup_key, channel FROM a""",
)
def _(t):
    a = t.audit_events.where(~F.col("success")).select(F.col("resource_type").alias("rule_id"), text("event_id").alias("run_id"), "severity")
    return quality.alert_routing(a).select("dedup_key", "channel")
