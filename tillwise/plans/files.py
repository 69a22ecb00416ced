"""Catalogue: file sources, generated axes and sinks.

File queries write the given tables in the format first (to the shared scratch
folder) and read them back through the operator.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.columns import dbl, text
from tillwise.operators import marts
from tillwise.plans.registry import query
from tillwise.session import scratch_path
from tillwise.sources import calendar, delimited, files, sinks

LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
LINE_SQL = """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey, CAST(l_suppkey AS VARCHAR) AS l_suppkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
  CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS l_quantity, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS l_extendedprice,
  l_returnflag || CASE WHEN l_partkey % 5 = 0 THEN chr(10) ELSE ',"' END || l_linestatus || CASE WHEN l_partkey % 5 = 0 THEN '' ELSE '"' END AS l_returnflag, strftime(l_shipdate, '%m/%d/%Y') AS l_shipdate FROM lineitem"""


def line_text(lines):
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    return lines.select(
        *[text(c).alias(c) for c in LINE_COLUMNS[:4]],
        money("l_quantity").alias("l_quantity"),
        F.when(F.col("l_partkey") % 7 != 0, money("l_extendedprice")).alias("l_extendedprice"),
        F.when(F.col("l_partkey") % 5 == 0, F.concat("l_returnflag", F.lit("\n"), "l_linestatus"))  # a line break inside a value
        .otherwise(F.concat("l_returnflag", F.lit(',"'), "l_linestatus", F.lit('"')))
        .alias("l_returnflag"),
        F.date_format("l_shipdate", "MM/dd/yyyy").alias("l_shipdate"),
    )


def line_csv(t, sep=",") -> str:
    path = scratch_path(t.spark, "csv")
    line_text(t.lineitem).write.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return path


@query("scan_csv", LINE_SQL)
def _(t):
    return files.scan_csv(t.spark, line_csv(t, ";"), sep=";")


@query("scan_csv_text", LINE_SQL)
def _(t):
    # the content is at hand as lines, cut anywhere
    lines = delimited.text_lines(t.spark, line_csv(t))
    return delimited.records(lines, LINE_COLUMNS, delimited.Dialect(), skip=1)


UPLOADS = 64  # files


@query(
    "csv_map_columns",
    """
SELECT l_orderkey AS order_id, CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2))::DOUBLE END AS price, strftime(l_shipdate, '%Y-%m-%dT00:00:00') AS shipped,
  row_number() OVER (PARTITION BY ((COALESCE(l_orderkey, 0) + COALESCE(l_partkey, 0)) % 64 + 64) % 64
    ORDER BY l_orderkey NULLS FIRST, l_linenumber NULLS FIRST, l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST, l_extendedprice NULLS FIRST,
      l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_shipdate NULLS FIRST) AS _csv_row_number,
  'upload' AS _csv_source, true AS processed
FROM lineitem""",
)
def _(t):
    # what a file holds, and in which order, follows from the values alone, so that places can be told
    key = F.coalesce("l_orderkey", F.lit(0)) + F.coalesce("l_partkey", F.lit(0))
    lines = t.lineitem.repartitionById(UPLOADS, F.pmod(key, F.lit(UPLOADS)).cast("int")).sortWithinPartitions(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    path = scratch_path(t.spark, "csv")
    line_text(lines).write.option("header", True).option("escape", '"').csv(path)
    df = files.scan_csv(t.spark, path, skip_rows=0, numbered=files.ROW_NUMBER)
    out = files.map_columns(
        df, {"l_orderkey": "order_id", "l_extendedprice": "price", "l_shipdate": "shipped"},
        dates=["shipped"], numbers=["price"], required=["order_id"], source="upload",
    )
    return out.select(
        F.col("order_id").try_cast("long").alias("order_id"), "price", "shipped", files.ROW_NUMBER, "_csv_source",
        F.col("_csv_processed_at").isNotNull().alias("processed"),
    )


@query(
    "csv_row_numbers",
    "SELECT count(*) + count(*) FILTER (l_partkey % 5 = 0) AS lines, count(*) + count(*) FILTER (l_partkey % 5 = 0) AS distinct_positions, count(*) + count(*) FILTER (l_partkey % 5 = 0) AS numbered FROM lineitem",
)
def _(t):
    path = scratch_path(t.spark, "csv")
    line_text(t.lineitem).write.csv(path)
    numbered = files.number_lines(files.text_lines(t.spark, path))
    per_file = numbered.groupBy("file").agg(F.max("_csv_row_number").alias("m"), F.count("*").alias("n"), F.count_distinct("_csv_row_number").alias("d"))
    return per_file.agg(F.sum("n").alias("lines"), F.sum("d").alias("distinct_positions"), F.sum("m").alias("numbered"))


@query(
    "csv_parse_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'later' ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00') END AS parsed FROM orders",
)
def _(t):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "  ").when(k == 1, "later").when(k == 2, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", files.parse_date(raw).alias("parsed"))


@query(
    "csv_parse_numeric",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS parsed FROM orders",
)
def _(t):
    money = F.format_string("$%,.2f", F.col("o_totalprice"))
    raw = F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(money)
    return t.orders.select("o_orderkey", files.parse_numeric(raw).alias("parsed"))


@query(
    "csv_preview",
    """
SELECT 'l_orderkey' AS "column", 'numeric' AS type, count(*) AS filled FROM lineitem UNION ALL SELECT 'l_partkey', 'numeric', count(*) FROM lineitem
UNION ALL SELECT 'l_suppkey', 'numeric', count(*) FROM lineitem UNION ALL SELECT 'l_linenumber', 'numeric', count(*) FROM lineitem
UNION ALL SELECT 'l_quantity', 'numeric', count(*) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'numeric', count(*) FILTER (l_partkey % 7 <> 0) FROM lineitem
UNION ALL SELECT 'l_returnflag', 'text', count(*) FROM lineitem UNION ALL SELECT 'l_shipdate', 'date', count(*) FROM lineitem""",
)
def _(t):
    return files.infer_types(files.scan_csv(t.spark, line_csv(t)))


@query(
    "file_guard",
    """
SELECT 'csv' AS format, true AS accepted, count(*) AS lines FROM orders UNION ALL SELECT 'json', true, count(*) FROM customer
UNION ALL SELECT 'txt', false, count(*) FROM supplier UNION ALL SELECT 'csv', false, count(*) FROM part""",
)
def _(t):
    # the parts are one file above the limit; the other files are below it
    root = scratch_path(t.spark, "uploads")
    t.orders.select("o_orderkey").write.csv(f"{root}/orders")
    t.customer.select("c_custkey").write.json(f"{root}/customers")
    t.supplier.select(text("s_suppkey")).write.text(f"{root}/suppliers")
    wide = t.part.select(F.rpad(text("p_partkey"), 4000, "x"))
    wide.coalesce(1).write.csv(f"{root}/parts")
    most = int(t.part.count()) * 4000 - 1
    verdicts = files.guard(t.spark, root, most).where(F.col("length") > 0)
    lines = t.spark.read.option("recursiveFileLookup", "true").text(root).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))
    return verdicts.join(lines, "path").groupBy("format", "accepted").agg(F.sum("n").alias("lines"))


@query(
    "scan_table_query",
    "SELECT sale_id, CAST(amount AS DOUBLE) AS amount, 'sales' AS _db_source FROM sales WHERE branch_id = 4 AND is_active ORDER BY sales.amount DESC, sale_id LIMIT 40 OFFSET 10",
)
def _(t):
    return files.select_contract(
        t.sales, ["sale_id", "CAST(amount AS DOUBLE) AS amount"], (F.col("branch_id") == 4) & F.col("is_active"),
        [F.desc("amount"), F.asc("sale_id")], limit=40, offset=10, tag="sales",
    ).drop("_db_extracted_at")


@query(
    "scan_document",
    """
SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, 'customers' AS _mongo_collection FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')
ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 5""",
)
def _(t):
    path = scratch_path(t.spark, "collection")
    t.customer.withColumnRenamed("c_custkey", "_id").write.json(path)
    return files.scan_documents(
        t.spark, path, "_id long, c_name string, c_acctbal double, c_mktsegment string",
        {"c_acctbal": {"$gte": 1000, "$lt": 5000}, "c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}},
        ["_id", "c_name"], [("c_acctbal", -1), ("_id", 1)], skip=5, limit=50, collection="customers",
    ).drop("_mongo_extracted_at")


def landed_pages(t):
    """Pages of 50 events per type; each type answers with another envelope."""
    e = t.events.select("event_id", "event_type", (F.expr("event_id div 250")).alias("page"), F.to_json(F.struct("event_id", "user_id")).alias("r"))
    pages = e.groupBy("event_type", "page").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    body = F.concat(F.lit("["), F.array_join("rs", ","), F.lit("]"))
    kind = F.col("event_type")
    wrapped = (
        F.when(kind == "error", body)
        .when(kind == "view", F.concat(F.lit('{"data":'), body, F.lit(',"has_next":'), F.when(F.col("page") == 20, "false").otherwise("true"), F.lit("}")))
        .when(kind == "click", F.concat(F.lit('{"results":'), body, F.lit(',"current_page":'), text("page"), F.lit(',"total_pages":10}')))
        .when(kind == "purchase", F.when(F.col("page") == 15, "<html>busy</html>").otherwise(F.concat(F.lit('{"items":'), body, F.lit("}"))))
        .otherwise(F.get("rs", F.lit(0)))
    )
    return pages.select(kind.alias("endpoint"), "page", wrapped.alias("body"))


@query(
    "scan_paged_json",
    """
WITH p AS (SELECT event_type AS endpoint, event_id // 250 AS page, event_id, row_number() OVER (PARTITION BY event_type, event_id // 250 ORDER BY CAST(event_id AS VARCHAR)) AS rn FROM events)
SELECT endpoint, CAST(page AS BIGINT) AS page, event_id FROM p WHERE endpoint = 'error' OR (endpoint = 'view' AND page <= 20) OR (endpoint = 'click' AND page <= 10)
  OR (endpoint = 'purchase' AND page < 15) OR (endpoint = 'signup' AND rn = 1)""",
)
def _(t):
    # a page is never short, so the errors are read to their last page
    out = files.page_records(landed_pages(t), page_size=1)
    return out.select("endpoint", "page", F.get_json_object("record", "$.event_id").cast("long").alias("event_id"))


@query(
    "incremental_scan",
    "SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-21 12:00:00'",
)
def _(t):
    stored = t.events.where(F.col("ts") <= "2024-01-21 12:00:00").agg(F.lit("2024-01-21 12:00:00").alias("position")).select(F.lit("events").alias("source"), "position")
    fresh, _ = files.incremental(t.events, "ts", stored, "events")
    return fresh.select("event_id", "user_id")


@query(
    "scan_log_json",
    """
SELECT CASE WHEN event_id % 50 = 0 THEN 'broken' ELSE level END AS level, count(*) AS n, count(*) FILTER (event_id % 50 <> 0 AND event_id % 7 <> 0) AS with_time FROM log_entries GROUP BY 1""",
)
def _(t):
    path = scratch_path(t.spark, "log")
    e = t.log_entries
    stamp = F.when(F.col("event_id") % 7 == 0, F.lit("yesterday")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    line = F.to_json(F.struct(stamp.alias("timestamp"), "level", "message", "user_id", "ip", "action", "endpoint", "status", "duration"))
    e.select(F.when(F.col("event_id") % 50 == 0, F.left(line, F.lit(20))).otherwise(line).alias("value")).write.text(path)
    log = files.scan_log(t.spark, path)
    level = F.when(F.col("_corrupt").isNotNull(), "broken").otherwise(F.col("level"))
    return log.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.count("ts").alias("with_time"))


@query(
    "gen_dim_date",
    """
WITH d AS (SELECT CAST(unnest(generate_series(min(sale_date), max(sale_date), INTERVAL 1 DAY)) AS DATE) AS d FROM sales), s AS (SELECT sale_date AS d, count(*) AS n FROM sales GROUP BY 1)
SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d.d AS VARCHAR) AS date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name,
  CAST(day(d) AS INTEGER) AS day, CAST(dayofweek(d) AS INTEGER) AS day_of_week, dayname(d) AS day_name, CAST(weekofyear(d) AS INTEGER) AS week_of_year, dayofweek(d) IN (0, 6) AS is_weekend,
  CAST(year(d) AS INTEGER) AS fiscal_year, CAST(quarter(d) AS INTEGER) AS fiscal_quarter, coalesce(n, 0) AS sales_count FROM d LEFT JOIN s USING (d)""",
)
def _(t):
    counts = t.sales.groupBy(F.col("sale_date").alias("date")).agg(F.count("*").alias("sales_count"))
    axis = calendar.axis_of(t.sales, "sale_date", "day").select(F.to_date("t").alias("date"))
    dims = calendar.dim_date(axis)
    return dims.join(counts, "date", "left").na.fill(0, ["sales_count"]).withColumn("date", text("date"))


@query(
    "gen_dim_time",
    """
WITH m AS (SELECT range AS m, range // 60 AS h FROM range(1440)), s AS (SELECT hour(ts) * 60 + minute(ts) AS m, count(*) AS n FROM sales GROUP BY 1)
SELECT CAST(h * 100 + m % 60 AS INTEGER) AS time_key, CAST(h AS INTEGER) AS hour, CAST(m % 60 AS INTEGER) AS minute, 0 AS second, CAST(CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END AS INTEGER) AS hour_12,
  CASE WHEN h < 12 THEN 'AM' ELSE 'PM' END AS am_pm, lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') AS time_name,
  CASE WHEN h BETWEEN 6 AND 14 THEN 'Morning' WHEN h BETWEEN 14 AND 22 THEN 'Evening' ELSE 'Night' END AS shift, coalesce(n, 0) AS sales_count FROM m LEFT JOIN s USING (m)""",
)
def _(t):
    counts = t.sales.groupBy((F.hour("ts") * 100 + F.minute("ts")).alias("time_key")).agg(F.count("*").alias("sales_count"))
    return calendar.dim_time(t.spark).join(counts, "time_key", "left").na.fill(0, ["sales_count"])


@query(
    "gen_time_range",
    """
SELECT 'hour' AS step, CAST(unnest(generate_series(date_trunc('hour', min(ts)), max(ts), INTERVAL 1 HOUR)) AS VARCHAR) AS t FROM events
UNION ALL SELECT 'day', CAST(unnest(generate_series(CAST(date_trunc('day', min(ts)) AS TIMESTAMP), max(ts), INTERVAL 1 DAY)) AS VARCHAR) FROM events
UNION ALL SELECT 'week', CAST(unnest(generate_series(CAST(date_trunc('day', min(ts)) AS TIMESTAMP), max(ts), INTERVAL 7 DAY)) AS VARCHAR) FROM events
UNION ALL SELECT 'month', CAST(unnest(generate_series(CAST(date_trunc('month', min(ts)) AS TIMESTAMP), max(ts), INTERVAL 1 MONTH)) AS VARCHAR) FROM events""",
)
def _(t):
    parts = [calendar.axis_of(t.events, "ts", s).select(F.lit(s).alias("step"), text("t").alias("t")) for s in ("hour", "day", "week", "month")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "sink_fact_append",
    "SELECT strftime(sale_date, '%Y-%m') AS month, count(*) * 2 AS rows, CAST(sum(amount) * 2 AS DOUBLE) AS amount FROM sales GROUP BY 1",
)
def _(t):
    path = scratch_path(t.spark, "fact")
    for _ in range(2):
        sinks.append_fact(t.sales, "sales", path)
    back = t.spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    return back.groupBy(text("month").alias("month")).agg(F.count("*").alias("rows"), dbl(F.sum("amount")).alias("amount"))


def daily_mart(t):
    d = marts.daily_sales(t.sales, sources=("pos", "api_sales", "csv_upload"))
    return d.withColumns({"month": F.left("sale_date", F.lit(7)), "updated_at": F.lit(None).cast("timestamp")})


@query(
    "sink_upsert_agg",
    """
WITH a AS (SELECT sale_date, branch_id, sum(amount) AS s, count(*) AS n FROM sales GROUP BY 1, 2), b AS (SELECT sale_date, branch_id, sum(amount) AS s, count(*) AS n FROM sales WHERE source <> 'pos' GROUP BY 1, 2),
c AS (SELECT sale_date, CAST(branch_id + 100 AS INTEGER) AS branch_id, sum(amount) AS s, count(*) AS n FROM sales WHERE source = 'pos' AND branch_id = 3 GROUP BY 1, 2)
SELECT CAST(a.sale_date AS VARCHAR) AS sale_date, a.branch_id, CAST(coalesce(b.s, a.s) AS DOUBLE) AS total_sales, coalesce(b.n, a.n) AS transaction_count, b.n IS NOT NULL AS stamped
FROM a LEFT JOIN b ON a.sale_date = b.sale_date AND a.branch_id = b.branch_id UNION ALL SELECT CAST(sale_date AS VARCHAR), branch_id, CAST(s AS DOUBLE), n, false FROM c""",
)
def _(t):
    path = scratch_path(t.spark, "mart")
    daily_mart(t).write.partitionBy("month").parquet(path)
    again = marts.daily_sales(t.sales, sources=("api_sales", "csv_upload"))
    extra = marts.daily_sales(t.sales.where("branch_id = 3"), sources=("pos",)).withColumn("branch_id", F.col("branch_id") + 100)
    update = again.unionByName(extra).withColumn("month", F.left("sale_date", F.lit(7)))
    sinks.upsert_table(t.spark, path, update, ["month", "sale_date", "branch_id"], ["total_sales", "transaction_count", "avg_sale"], F.current_timestamp(), "month")
    back = t.spark.read.parquet(path)
    return back.select("sale_date", "branch_id", "total_sales", "transaction_count", F.col("updated_at").isNotNull().alias("stamped"))


@query(
    "sink_upsert_dimension",
    """
WITH s AS (SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS st FROM orders GROUP BY 1)
SELECT CASE WHEN c_custkey % 3 = 0 AND o_custkey IS NOT NULL THEN 'inserted' WHEN o_custkey IS NOT NULL THEN 'updated' ELSE 'kept' END AS _action, coalesce(st, c_mktsegment) AS label, count(*) AS n
FROM customer LEFT JOIN s ON c_custkey = o_custkey WHERE c_custkey % 3 <> 0 OR o_custkey IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    target = t.customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("label"), F.lit(None).cast("timestamp").alias("updated_at"))
    feed = t.orders.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("label"), F.struct("o_orderdate", "o_orderkey").alias("pos"))
    source = sinks.last_per_key(feed, ["customer_id"], "pos")
    merged = sinks.merge(target, source, ["customer_id"], ["label"], F.current_timestamp())
    return merged.groupBy("_action", "label").agg(F.count("*").alias("n"))


@query(
    "sink_scd2_dimension",
    """
SELECT c_custkey AS customer_id, c_mktsegment AS segment, '2000-01-01' AS effective_from, CASE WHEN c_custkey % 5 = 0 THEN '2001-06-01' END AS effective_to FROM customer WHERE c_custkey % 4 <> 0
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END, '2001-06-01', NULL FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 5 = 0""",
)
def _(t):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    current = t.customer.where(k % 4 != 0).select(
        k.alias("customer_id"), seg.alias("segment"), F.to_date(F.lit("2000-01-01")).alias("effective_from"), F.lit(None).cast("date").alias("effective_to")
    )
    incoming = t.customer.select(k.alias("customer_id"), F.when(k % 5 == 0, F.lower(seg)).otherwise(seg).alias("segment"))
    out = sinks.scd2(current, incoming, "customer_id", ["segment"], F.to_date(F.lit("2001-06-01")))
    return out.select("customer_id", "segment", text("effective_from").alias("effective_from"), text("effective_to").alias("effective_to"))


# Rules, findings and metrics derived from products, errors and runs, as (id, rule_name, …).
EXPORT_SQL = """rules AS (SELECT p_partkey AS id, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'null_rate' WHEN 1 THEN 'range_check' ELSE 'row_count' END AS check_type, CASE WHEN p_size > 40 THEN 'HIGH' ELSE 'LOW' END AS severity, p_size / 50.0 AS threshold FROM part),
now AS (SELECT max(ts) AS m FROM events),
chosen_rules AS (SELECT id, name FROM rules WHERE name ILIKE '%RE%' AND check_type = 'null_rate' AND severity = 'LOW'),
chosen_runs AS (SELECT run_id, rule_id FROM dq_runs, now WHERE finished_at >= m - INTERVAL 7 DAYS AND rule_id ILIKE '%E%' ORDER BY finished_at DESC, run_id DESC LIMIT 120),
chosen_violations AS (SELECT event_id, 'check ' || CAST(user_id % 7 AS VARCHAR) AS rule FROM events, now WHERE event_type = 'error' AND ts >= m - INTERVAL 20 DAYS AND user_id % 7 = 3 ORDER BY ts DESC, event_id DESC LIMIT 10000),
chosen_metrics AS (SELECT run_id, rule_id, rows_scanned FROM dq_runs, now WHERE finished_at >= m - INTERVAL 2 DAYS ORDER BY finished_at DESC, run_id DESC LIMIT 10000)"""


@query(
    "sink_export",
    f"""
WITH {EXPORT_SQL}, read AS (
  SELECT 'rules' AS export_type, CAST(id AS VARCHAR) AS id, name AS label FROM chosen_rules UNION ALL SELECT 'runs', run_id, rule_id FROM chosen_runs
  UNION ALL SELECT 'violations', CAST(event_id AS VARCHAR), rule FROM chosen_violations UNION ALL SELECT 'metrics', run_id, rule_id || ' ' || CAST(rows_scanned AS VARCHAR) FROM chosen_metrics)
SELECT f AS format, export_type, id, label, count(*) OVER (PARTITION BY f, export_type) AS total_records FROM read, (VALUES ('csv'), ('json')) AS v(f)""",
)
def _(t):
    now = marts.max_of(t.events, "ts")
    check = F.col("p_partkey") % 3
    rules = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(check == 0, "null_rate").when(check == 1, "range_check").otherwise("row_count").alias("check_type"),
        F.when(F.col("p_size") > 40, "HIGH").otherwise("LOW").alias("severity"), (F.col("p_size") / 50.0).alias("threshold"),
    )
    runs = t.dq_runs.withColumnsRenamed({"run_id": "id", "rule_id": "rule_name"})
    violations = t.events.where("event_type = 'error'").select(
        F.col("event_id").alias("id"), F.concat(F.lit("check "), text(F.col("user_id") % 7)).alias("rule_name"), F.lit("OUT_OF_RANGE").alias("violation_type"), F.col("ts").alias("detected_at"),
    )
    metrics = t.dq_runs.select(F.col("run_id").alias("id"), F.col("rule_id").alias("rule_name"), F.lit("rows_scanned").alias("metric_name"), F.col("rows_scanned").alias("metric_value"), F.col("finished_at").alias("recorded_at"))
    chosen = {
        "rules": (sinks.export_rows(rules, "rules", rule_name="RE", check_type="null_rate", severity="LOW"), F.col("name")),
        "runs": (sinks.export_rows(runs, "runs", now, days=7, rule_name="E", limit=120), F.col("rule_name")),
        "violations": (sinks.export_rows(violations, "violations", now, days=20, rule_name="CHECK 3"), F.col("rule_name")),
        "metrics": (sinks.export_rows(metrics, "metrics", now, days=2), F.concat_ws(" ", "rule_name", "metric_value")),
    }
    out = None
    for name, (rows, label) in chosen.items():
        for form in ("csv", "json"):
            path = scratch_path(t.spark, f"export-{name}")
            sinks.write_export(rows, path, form, name)
            data = t.spark.read.schema(rows.schema) if form == "json" else t.spark.read.option("header", True)
            read = data.format(form).load(f"{path}/data").select(F.lit(form).alias("format"), F.lit(name).alias("export_type"), text("id").alias("id"), text(label).alias("label"))
            head = t.spark.read.schema("export_type string, exported_at string, total_records bigint").json(f"{path}/envelope")
            part = read.join(head.select("export_type", "total_records"), "export_type")
            out = part if out is None else out.unionByName(part)
    return out


@query(
    "sink_csv_quoted",
    """SELECT '"' || CAST(p_partkey AS VARCHAR) || '","' || replace(p_name || ' "' || p_type || '"', '"', '""') || '","' || CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '' END || '"' AS line FROM part""",
)
def _(t):
    path = scratch_path(t.spark, "quoted")
    p = t.part.select("p_partkey", F.concat("p_name", F.lit(' "'), "p_type", F.lit('"')).alias("label"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"))
    sinks.write_quoted_csv(p, path, {"p_partkey": "Part", "label": "Label", "p_size": "Size"})
    return t.spark.read.text(path).where(~F.col("value").startswith('"Part"')).select(F.col("value").alias("line"))


@query(
    "sink_dsar_json",
    "SELECT o_custkey AS subject_id, 'orders' AS \"table\", count(*) AS rows FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY 1 UNION ALL SELECT c_custkey, 'customer', 1 FROM customer WHERE c_acctbal < 0",
)
def _(t):
    who = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("subject_id"))
    o = t.orders.join(who, F.col("o_custkey") == F.col("subject_id")).select("subject_id", F.lit("orders").alias("table"), F.to_json(F.struct("o_orderkey", "o_totalprice")).alias("record"))
    c = t.customer.join(who, F.col("c_custkey") == F.col("subject_id")).select("subject_id", F.lit("customer").alias("table"), F.to_json(F.struct("c_name")).alias("record"))
    path = scratch_path(t.spark, "dsar")
    # one writer per subject, so that a subject has one file per table; the number keeps
    # adaptive execution from joining the writers, whose time goes by files, not bytes
    writers = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    sinks.write_subject_files(o.unionByName(c).repartition(writers, "subject_id"), path)
    back = sinks.read_subject_files(t.spark, path, "record string")
    return back.groupBy("subject_id", "table").agg(F.count("*").alias("rows"))


@query(
    "sink_checksum_manifest",
    """
SELECT part, CASE WHEN part = '1995' THEN 'missing' WHEN part = '1996' THEN 'mismatch' ELSE 'ok' END AS state FROM (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS part FROM orders)""",
)
def _(t):
    part = text(F.year("o_orderdate"))
    stored = sinks.manifest(t.orders, part)
    # a damaged copy: one year lost, one value changed in another
    price = F.when((F.year("o_orderdate") == 1996) & (F.col("o_orderkey") % 100 == 0), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    damaged = t.orders.where(F.year("o_orderdate") != 1995).withColumn("o_totalprice", price)
    return sinks.verify(stored, sinks.manifest(damaged, part))
