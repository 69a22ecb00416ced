"""Catalogue: business updates, user functions and table upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillwise.functions import registries
from tillwise.functions.checks import Check, passes
from tillwise.functions.columns import text
from tillwise.functions.transforms import Rule, apply_rules
from tillwise.operators import updates
from tillwise.plans.registry import query
from tillwise.session import scratch_path


@query(
    "upd_bulk_stock",
    """
WITH c AS (SELECT l_partkey * 2 AS product_id, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1)
SELECT coalesce(s.product_id, c.product_id) AS product_id, stock_quantity AS old_value, CASE WHEN s.product_id IS NOT NULL THEN coalesce(q, stock_quantity) END AS new_value,
  CASE WHEN s.product_id IS NULL THEN 'missing' WHEN c.product_id IS NULL THEN 'unchanged' ELSE 'updated' END AS status FROM stock s FULL JOIN c ON s.product_id = c.product_id""",
)
def _(t):
    wanted = t.sale_items.groupBy((F.col("product_id") * 2).alias("product_id")).agg(F.max("qty").alias("stock_quantity"))
    return updates.bulk_set(t.stock, wanted, "product_id", "stock_quantity")


FOLD = "list_reduce(list_prepend({start}, q), lambda v, x: CASE WHEN v % 1000000 >= x THEN v - x + 1000000 ELSE v END)"


@query(
    "upd_inventory_depletion",
    f"""
WITH d AS (SELECT product_id, list(qty ORDER BY ship_date, sale_id, line_number, qty) AS q FROM sale_items GROUP BY 1),
f AS (SELECT product_id, reorder_level, {FOLD.format(start='stock_quantity')} AS v, len(q) AS n FROM stock JOIN d USING (product_id) UNION ALL SELECT product_id, reorder_level, stock_quantity, 0 FROM stock WHERE product_id NOT IN (SELECT product_id FROM d))
SELECT product_id, CAST(v % 1000000 AS BIGINT) AS remaining, CAST(v // 1000000 AS BIGINT) AS accepted, CAST(n - v // 1000000 AS BIGINT) AS refused, v % 1000000 <= reorder_level AS is_low FROM f""",
)
def _(t):
    out = updates.deplete(
        t.stock.select("product_id", "reorder_level", "stock_quantity"), t.sale_items, "product_id", "stock_quantity", "qty",
        ["ship_date", "sale_id", "line_number"],
    )
    return out.select("product_id", "remaining", "accepted", "refused", (F.col("remaining") <= F.col("reorder_level")).alias("is_low"))


@query(
    "upd_loyalty_redeem",
    f"""
WITH d AS (SELECT user_id AS customer_id, list(k ORDER BY ts, event_id) AS q FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events) WHERE k > 0 GROUP BY 1),
f AS (SELECT customer_id, {FOLD.format(start='loyalty_points')} AS v, len(q) AS n FROM clients JOIN d USING (customer_id) UNION ALL SELECT customer_id, loyalty_points, 0 FROM clients WHERE customer_id NOT IN (SELECT customer_id FROM d))
SELECT customer_id, CAST(v % 1000000 AS BIGINT) AS points_left, CAST(v // 1000000 AS BIGINT) AS redeemed, CAST(n - v // 1000000 AS BIGINT) AS refused FROM f""",
)
def _(t):
    asks = t.events.select(F.col("user_id").alias("customer_id"), "ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("points"))
    out = updates.deplete(t.clients.select("customer_id", "loyalty_points"), asks, "customer_id", "loyalty_points", "points", ["ts", "event_id"])
    return out.select("customer_id", F.col("remaining").alias("points_left"), F.col("accepted").alias("redeemed"), "refused")


@query(
    "upd_inventory_status",
    "SELECT product_id, CASE WHEN expiry_date < (SELECT max(sale_date) FROM sales) THEN 'expired' WHEN stock_quantity <= reorder_level THEN 'low_stock' ELSE 'in_stock' END AS status FROM stock",
)
def _(t):
    status = updates.inventory_status(F.col("stock_quantity"), F.col("reorder_level"), F.col("expiry_date"), t.last_sale_day)
    return t.stock.select("product_id", status.alias("status"))


@query(
    "upd_audit_snapshot",
    """
SELECT event_id, c_name AS user_name, c_mktsegment AS user_role, sha256(CAST(event_id AS VARCHAR) || '|' || action || '|' || CAST(user_id AS VARCHAR)) AS audit_key,
  CAST(CAST(CAST(ts AS DATE) + INTERVAL 84 MONTHS AS DATE) AS VARCHAR) AS retain_until FROM audit_events LEFT JOIN customer ON user_id = c_custkey""",
)
def _(t):
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), F.col("c_mktsegment").alias("user_role"))
    out = updates.audit_snapshot(t.audit_events, users)
    return out.select("event_id", "user_name", "user_role", "audit_key", text("retain_until").alias("retain_until"))


# Every character that differs from the one before it.
SQUEEZED = "array_to_string([substring(c_name, i, 1) for i in range(1, len(c_name) + 1) if i = 1 OR substring(c_name, i, 1) <> substring(c_name, i - 1, 1)], '')"


@query("udf_transformers", f"SELECT c_custkey, {SQUEEZED} AS squeezed, left(c_mktsegment, 4) AS clipped FROM customer")
def _(t):
    registries.register_defaults()
    rules = [
        Rule("c_name", "squeezed", "custom", {"function": "squeeze"}),
        Rule("c_mktsegment", "clipped", "custom", {"function": "clip", "length": 4}),
    ]
    return apply_rules(t.customer, rules).select("c_custkey", "squeezed", "clipped")


@query("udf_validators", "SELECT p_partkey, starts_with(p_name, 'red') AS ok FROM part")
def _(t):
    registries.register_defaults()
    return t.part.select("p_partkey", passes(Check("p_name", "custom", {"function": "starts_with", "prefix": "red"}), t.part.columns).alias("ok"))


# A rule table with one rule per product, some of them badly set up.
@query(
    "udf_rule_validators",
    """
WITH r AS (SELECT p_partkey AS rule_id, CASE p_partkey % 4 WHEN 0 THEN 'null_rate' WHEN 1 THEN 'range_check' WHEN 2 THEN 'row_count' ELSE 'uniqueness' END AS k, CASE WHEN p_size > 10 THEN p_name ELSE '' END AS c, p_size / 30.0 - 0.5 AS th, CASE WHEN p_size % 3 = 0 THEN p_retailprice END AS lo FROM part)
SELECT rule_id, CASE k WHEN 'null_rate' THEN concat_ws('; ', CASE WHEN c = '' THEN 'null_rate needs a column' END, CASE WHEN NOT th BETWEEN 0 AND 1 THEN 'null_rate threshold must be between 0 and 1' END)
  WHEN 'range_check' THEN concat_ws('; ', CASE WHEN c = '' THEN 'range_check needs a column' END, CASE WHEN lo IS NULL THEN 'range_check needs a bound' END)
  WHEN 'row_count' THEN concat_ws('; ', CASE WHEN th < 0 THEN 'row_count threshold must not be negative' END) ELSE '' END AS problems FROM r""",
)
def _(t):
    k = F.col("p_partkey") % 4
    rules = t.part.select(
        F.col("p_partkey").alias("rule_id"),
        F.when(k == 0, "null_rate").when(k == 1, "range_check").when(k == 2, "row_count").otherwise("uniqueness").alias("check_type"),
        F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("").alias("target_column"),
        (F.col("p_size") / 30.0 - 0.5).alias("threshold"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice")).alias("min_value"),
        F.lit(None).cast("double").alias("max_value"),
    )
    return rules.select("rule_id", F.array_join(registries.rule_problems(), "; ").alias("problems"))


@query(
    "udf_table_spans",
    "SELECT customer_id, 'email' AS kind, 0 AS start, length(email) AS \"end\", email AS value FROM clients",
)
def _(t):
    texts = t.clients.select(F.col("customer_id").cast("long").alias("row"), F.col("email").alias("text"))
    spans = registries.PiiSpans(texts.asTable())
    return spans.select(F.col("row").alias("customer_id"), "kind", "start", "end", "value")


@query(
    "maint_statistics",
    "SELECT 'o_orderkey' AS \"column\", CAST(min(o_orderkey) AS VARCHAR) AS min, CAST(max(o_orderkey) AS VARCHAR) AS max, '0' AS num_nulls FROM orders UNION ALL SELECT 'o_custkey', CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR), '0' FROM orders",
)
def _(t):
    name = f"orders_{uuid.uuid4().hex}"
    path = scratch_path(t.spark, "stats")
    t.orders.select("o_orderkey", "o_custkey").write.parquet(path)
    t.spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
    return updates.analyze(t.spark, name).select("column", "min", "max", "num_nulls")


@query(
    "maint_compaction",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS rows, 1::BIGINT AS files, true AS fewer FROM orders GROUP BY 1",
)
def _(t):
    path = scratch_path(t.spark, "small")
    t.orders.withColumn("year", F.year("o_orderdate")).repartition(8).write.partitionBy("year").parquet(path)
    before = updates.file_counts(t.spark, path, "year").select("year", F.col("files").alias("files_before"))
    counted = t.spark.createDataFrame(before.collect(), before.schema)  # one row per partition, before the rewrite
    updates.compact(t.spark, path, "year")
    after = updates.file_counts(t.spark, path, "year")
    return after.join(counted, "year").select("year", "rows", "files", (F.col("files") < F.col("files_before")).alias("fewer"))
