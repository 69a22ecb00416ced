"""Business tables derived from the given tables, once on Spark and once as SQL
views for the cross-check. Both sides state the same derivation."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.session import spread

MONEY = "decimal(18,2)"

# Business meaning given to the generated codes (fixed values).
PAYMENT = {"1": "cash", "2": "card", "3": "mobile", "4": "voucher", "5": "online"}
ORDER_TYPE = {"F": "dine_in", "O": "takeaway", "P": "delivery"}
SOURCE = {
    "purchase": "pos",
    "click": "api_sales",
    "view": "inventory",
    "signup": "staff",
    "error": "csv_upload",
}
LOG_ACTION = {
    "error": "login",
    "view": "api",
    "click": "export_report",
    "purchase": "sale",
    "signup": "create",
}
AUDIT_ACTION = {
    "error": "LOGIN_FAILED",
    "view": "PII_ACCESS",
    "click": "DATA_ACCESS",
    "purchase": "SECURITY_CONFIG_CHANGED",
    "signup": "CREATE",
}
LOG_EPOCH_US = 1704067200000000  # 2024-01-01T00:00:00Z


def recode(col: str | Column, mapping: dict[str, str]) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = None
    for key, value in mapping.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out


def sql_recode(col: str, mapping: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


class Tables:
    """The given tables of one folder and the business tables on top of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        return df.select(
            *[
                F.col(n).cast("timestamp").alias(n) if t == "timestamp_ntz" else F.col(n)
                for n, t in df.dtypes
            ]
        )

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.raw(name)

    @cached_property
    def sales(self) -> DataFrame:
        o = self.raw("orders")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        at = F.timestamp_seconds(
            F.unix_timestamp("o_orderdate") + F.col("o_orderkey") * 37 % 86400
        )
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("o_orderkey").alias("sale_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("c_nationkey").alias("branch_id"),
            at.alias("ts"),
            F.to_date("o_orderdate").alias("sale_date"),
            F.col("o_totalprice").cast(MONEY).alias("amount"),
            recode(F.left("o_orderpriority", F.lit(1)), PAYMENT).alias("payment_method"),
            recode("o_orderstatus", ORDER_TYPE).alias("order_type"),
            (F.col("o_totalprice") >= 20000).alias("is_active"),
            F.when(F.col("o_orderkey") % 3 == 0, "pos")
            .when(F.col("o_orderkey") % 3 == 1, "api_sales")
            .otherwise("csv_upload")
            .alias("source"),
        )

    @property
    def last_sale_day(self) -> Column:
        """Default ``as_of`` of the sales queries, read without the join."""
        return self.raw("orders").agg(F.max(F.to_date("o_orderdate")).alias("day")).scalar()

    @cached_property
    def sale_items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("sale_id"),
            F.col("l_linenumber").alias("line_number"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("staff_id"),
            F.col("l_quantity").cast("long").alias("qty"),
            F.col("l_extendedprice").cast(MONEY).alias("line_total"),
            F.col("l_discount").cast("decimal(4,2)").alias("discount_rate"),
            F.col("l_tax").cast("decimal(4,2)").alias("tax_rate"),
            F.col("l_returnflag").alias("return_flag"),
            F.to_date("l_shipdate").alias("ship_date"),
        )

    @cached_property
    def stock(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            k.alias("product_id"),
            F.col("p_name").alias("item_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            (k % 25).cast("int").alias("branch_id"),
            F.col("p_size").cast("long").alias("stock_quantity"),
            (k % 20 + 5).alias("reorder_level"),
            F.col("p_retailprice").cast(MONEY).alias("unit_cost"),
            F.date_add(F.lit("2001-01-01").cast("date"), (k % 400).cast("int")).alias("expiry_date"),
            (k % 17 != 0).alias("is_active"),
        )

    @cached_property
    def clients(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("customer_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
            F.concat(F.lit("+1202555"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("phone"),
            F.col("c_nationkey").alias("branch_id"),
            F.when(k % 10 != 0, F.col("c_nationkey")).alias("preferred_branch"),
            F.greatest(F.col("c_acctbal").cast(MONEY), F.lit(0).cast(MONEY)).alias("total_spent"),
            F.col("c_mktsegment").alias("segment"),
            (k % 40).alias("visit_count"),
            (k % 500).alias("loyalty_points"),
            F.date_sub(F.lit("2001-08-01").cast("date"), (k % 365).cast("int")).alias("last_visit"),
            (k % 50 != 0).alias("is_active"),
        )

    @cached_property
    def texts(self) -> DataFrame:
        """Documents, and a contact note per customer that holds personal data."""
        k = F.col("c_custkey")
        pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
        phone = (
            F.when(k % 3 == 0, F.concat(F.lit("+1 (202) 555-"), pad(k % 10000, 4)))
            .when(k % 3 == 1, F.concat(F.lit("+44 7"), pad(k % 900 + 100, 3), F.lit(" 123 456")))
            .otherwise("555-0199")
        )
        card = (
            F.when(k % 4 == 0, "4111 1111 1111 1111")
            .when(k % 4 == 1, "5500-0000-0000-0004")
            .when(k % 4 == 2, "378282246310005")
            .otherwise("4111 1111 1111 1112")
        )
        note = F.concat(
            F.lit("John Smith, mail "), F.when(k % 5 == 0, F.lit(".")).otherwise(F.lit("")),
            F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com, phone "), phone,
            F.lit(", ssn "), pad(k % 900, 3), F.lit("-"), pad(k % 100, 2), F.lit("-"), pad(k % 10000, 4),
            F.lit(", card "), card, F.lit(", ni AB123456C, ip 10.0."), (k % 300).cast("string"), F.lit(".7"),
        )
        notes = spread(self.raw("customer").select("c_custkey", "c_name")).select(
            F.concat(F.lit("c"), k.cast("string")).alias("text_id"), F.lit("customer_note").alias("field"), note.alias("body")
        )
        docs = self.raw("documents").select(
            F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"), F.lit("text").alias("field"), F.col("text").alias("body")
        )
        return docs.unionByName(notes)

    @cached_property
    def shifts(self) -> DataFrame:
        s = self.raw("supplier").select(
            F.col("s_suppkey").alias("staff_id"), F.col("s_nationkey").alias("branch_id")
        )
        # dealt by day first: counting different sales before a shuffle would keep nearly every line of a split in memory
        lines = self.sale_items.select("staff_id", F.col("ship_date").alias("shift_date"), "line_total", "sale_id", "qty")
        dealt = spread(lines, "staff_id", "shift_date")
        per_day = dealt.groupBy("staff_id", "shift_date").agg(
            F.sum("line_total").cast(MONEY).alias("sales_generated"),
            F.count_distinct("sale_id").alias("orders_served"),
            (F.sum("qty") % 9 + 4).alias("hours_worked"),
            F.count("*").alias("n_lines"),
        )
        return per_day.join(s, "staff_id").select(
            "staff_id",
            "branch_id",
            "shift_date",
            "sales_generated",
            "orders_served",
            "hours_worked",
            (((F.col("n_lines") * 7 + F.col("staff_id")) % 51).cast("double") / 10).alias("feedback"),
        )

    @cached_property
    def log_entries(self) -> DataFrame:
        at = F.timestamp_micros(
            F.lit(LOG_EPOCH_US) + F.expr(f"(unix_micros(ts) - {LOG_EPOCH_US}) div 720")
        )
        action = recode("event_type", LOG_ACTION)
        return self.raw("events").select(
            "event_id",
            at.alias("ts"),
            F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("user_id"),
            F.concat(F.lit("10.0.0."), (F.expr("user_id div 20") % 8).cast("string")).alias("ip"),
            action.alias("action"),
            F.when(F.col("event_type") == "error", 401).otherwise(200).alias("status"),
            F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
            F.when(F.col("event_type") == "view", "/api/items").otherwise("").alias("endpoint"),
            F.concat_ws(" ", F.lit("performed"), action).alias("message"),
            F.col("value").alias("duration"),
        )

    @cached_property
    def audit_events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        return self.raw("events").select(
            "event_id",
            "ts",
            "user_id",
            F.concat(F.lit("10.1.0."), (F.col("user_id") % 25).cast("string")).alias("ip"),
            recode("event_type", AUDIT_ACTION).alias("action"),
            F.when(k < 5, "CRITICAL").when(k < 20, "HIGH").when(k < 60, "MEDIUM").otherwise("LOW").alias("severity"),
            (~F.col("event_type").isin("error") & (k % 7 != 0)).alias("success"),
            F.when(F.col("user_id") % 3 == 0, "sales")
            .when(F.col("user_id") % 3 == 1, "inventory")
            .otherwise("customer")
            .alias("resource_type"),
            k.alias("k"),
        )

    @cached_property
    def raw_events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        return self.raw("events").select(
            "event_id",
            recode("event_type", SOURCE).alias("source"),
            F.when(k % 9 != 0, F.concat(F.lit("A"), F.expr("event_id div 2").cast("string"))).alias("business_key"),
            F.col("ts").alias("created_at"),
            "user_id",
            F.col("value").cast(MONEY).alias("amount"),
            k.alias("qty"),
            F.when(k % 5 == 0, "error").when(k % 2 == 0, "processed").otherwise("pending").alias("state"),
        )

    @cached_property
    def dq_runs(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        cells = (
            self.raw("events")
            .groupBy(
                F.col("event_type").alias("rule_id"), F.date_trunc("hour", "ts").alias("finished_at")
            )
            .agg(
                F.count_if(k >= 50).alias("violations_count"),
                F.count("*").alias("rows_scanned"),
                F.sum(F.col("value").cast(MONEY)).cast("double").alias("duration_seconds"),
            )
        )
        return cells.select(
            F.concat_ws("-", "rule_id", F.unix_timestamp("finished_at").cast("string")).alias("run_id"),
            "rule_id",
            "finished_at",
            "violations_count",
            "rows_scanned",
            "duration_seconds",
            F.when(F.col("violations_count") * 2 > F.col("rows_scanned"), "FAILED")
            .otherwise("SUCCESS")
            .alias("status"),
        )


SQL_VIEWS: dict[str, str] = {
    "sales": f"""
SELECT o_orderkey AS sale_id, o_custkey AS customer_id, c_nationkey AS branch_id,
  o_orderdate + to_seconds(CAST(o_orderkey * 37 % 86400 AS BIGINT)) AS ts,
  CAST(o_orderdate AS DATE) AS sale_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  {sql_recode("left(o_orderpriority, 1)", PAYMENT)} AS payment_method,
  {sql_recode("o_orderstatus", ORDER_TYPE)} AS order_type,
  o_totalprice >= 20000 AS is_active,
  CASE o_orderkey % 3 WHEN 0 THEN 'pos' WHEN 1 THEN 'api_sales' ELSE 'csv_upload' END AS source
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "sale_items": """
SELECT l_orderkey AS sale_id, l_linenumber AS line_number, l_partkey AS product_id, l_suppkey AS staff_id,
  CAST(l_quantity AS BIGINT) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total,
  CAST(l_discount AS DECIMAL(4,2)) AS discount_rate, CAST(l_tax AS DECIMAL(4,2)) AS tax_rate,
  l_returnflag AS return_flag, CAST(l_shipdate AS DATE) AS ship_date
FROM lineitem""",
    "stock": """
SELECT p_partkey AS product_id, p_name AS item_name, p_type AS category, p_brand AS brand,
  CAST(p_partkey % 25 AS INTEGER) AS branch_id, CAST(p_size AS BIGINT) AS stock_quantity,
  p_partkey % 20 + 5 AS reorder_level, CAST(p_retailprice AS DECIMAL(18,2)) AS unit_cost,
  DATE '2001-01-01' + CAST(p_partkey % 400 AS INTEGER) AS expiry_date, p_partkey % 17 <> 0 AS is_active
FROM part""",
    "clients": """
SELECT c_custkey AS customer_id, c_name AS name,
  lower(replace(c_name, '#', '.')) || '@example.com' AS email,
  '+1202555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
  c_nationkey AS branch_id, CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END AS preferred_branch,
  greatest(CAST(c_acctbal AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2))) AS total_spent,
  c_mktsegment AS segment, c_custkey % 40 AS visit_count, c_custkey % 500 AS loyalty_points,
  DATE '2001-08-01' - CAST(c_custkey % 365 AS INTEGER) AS last_visit, c_custkey % 50 <> 0 AS is_active
FROM customer""",
    "texts": """
SELECT 'd' || CAST(doc_id AS VARCHAR) AS text_id, 'text' AS field, text AS body FROM documents
UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'customer_note', 'John Smith, mail ' || CASE WHEN c_custkey % 5 = 0 THEN '.' ELSE '' END || lower(replace(c_name, '#', '.')) || '@example.com, phone '
  || CASE c_custkey % 3 WHEN 0 THEN '+1 (202) 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN '+44 7' || lpad(CAST(c_custkey % 900 + 100 AS VARCHAR), 3, '0') || ' 123 456' ELSE '555-0199' END
  || ', ssn ' || lpad(CAST(c_custkey % 900 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')
  || ', card ' || CASE c_custkey % 4 WHEN 0 THEN '4111 1111 1111 1111' WHEN 1 THEN '5500-0000-0000-0004' WHEN 2 THEN '378282246310005' ELSE '4111 1111 1111 1112' END
  || ', ni AB123456C, ip 10.0.' || CAST(c_custkey % 300 AS VARCHAR) || '.7' FROM customer""",
    "shifts": """
SELECT staff_id, s_nationkey AS branch_id, ship_date AS shift_date,
  CAST(sum(line_total) AS DECIMAL(18,2)) AS sales_generated,
  count(DISTINCT sale_id) AS orders_served, CAST(sum(qty) % 9 + 4 AS BIGINT) AS hours_worked,
  CAST((count(*) * 7 + staff_id) % 51 AS DOUBLE) / 10 AS feedback
FROM sale_items JOIN supplier ON staff_id = s_suppkey GROUP BY staff_id, s_nationkey, ship_date""",
    "log_entries": f"""
SELECT event_id, make_timestamp(CAST({LOG_EPOCH_US} + (epoch_us(ts) - {LOG_EPOCH_US}) // 720 AS BIGINT)) AS ts,
  'u' || CAST(user_id % 20 AS VARCHAR) AS user_id, '10.0.0.' || CAST((user_id // 20) % 8 AS VARCHAR) AS ip,
  {sql_recode("event_type", LOG_ACTION)} AS action,
  CASE WHEN event_type = 'error' THEN 401 ELSE 200 END AS status,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  CASE WHEN event_type = 'view' THEN '/api/items' ELSE '' END AS endpoint,
  'performed ' || {sql_recode("event_type", LOG_ACTION)} AS message, value AS duration
FROM events""",
    "audit_events": f"""
SELECT event_id, ts, user_id, '10.1.0.' || CAST(user_id % 25 AS VARCHAR) AS ip,
  {sql_recode("event_type", AUDIT_ACTION)} AS action,
  CASE WHEN k < 5 THEN 'CRITICAL' WHEN k < 20 THEN 'HIGH' WHEN k < 60 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  event_type <> 'error' AND k % 7 <> 0 AS success,
  CASE user_id % 3 WHEN 0 THEN 'sales' WHEN 1 THEN 'inventory' ELSE 'customer' END AS resource_type, k
FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)""",
    "raw_events": f"""
SELECT event_id, {sql_recode("event_type", SOURCE)} AS source,
  CASE WHEN k % 9 <> 0 THEN 'A' || CAST(event_id // 2 AS VARCHAR) END AS business_key,
  ts AS created_at, user_id, CAST(value AS DECIMAL(18,2)) AS amount, k AS qty,
  CASE WHEN k % 5 = 0 THEN 'error' WHEN k % 2 = 0 THEN 'processed' ELSE 'pending' END AS state
FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)""",
    "dq_runs": """
SELECT event_type || '-' || CAST(CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS VARCHAR) AS run_id,
  event_type AS rule_id, date_trunc('hour', ts) AS finished_at,
  count(*) FILTER (k >= 50) AS violations_count, count(*) AS rows_scanned,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS duration_seconds,
  CASE WHEN count(*) FILTER (k >= 50) * 2 > count(*) THEN 'FAILED' ELSE 'SUCCESS' END AS status
FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events) GROUP BY event_type, date_trunc('hour', ts)""",
}
