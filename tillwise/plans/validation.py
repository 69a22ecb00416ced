"""Catalogue: record validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions import checks as ck
from tillwise.functions.checks import Check, passes
from tillwise.functions.columns import dbl
from tillwise.plans.registry import query
from tillwise.plans.transforms import LOOSE_SQL, P, loose


def one_check(name: str, sql_expr: str, check: Check):
    """Register the verdict of one check over the loose records."""

    @query(name, f"WITH {LOOSE_SQL} SELECT k, n, {sql_expr} AS ok FROM loose")
    def _(t):
        df = loose(t)
        return df.select("k", "n", passes(check, df.columns).alias("ok"))


one_check("val_required", "trim(price) <> ''", Check("price", "required"))
one_check("val_type", f"{P} IS NOT NULL", Check("price", "type", {"type": "decimal"}))
one_check("val_range", f"coalesce({P} BETWEEN 1000 AND 50000, false)", Check("price", "range", {"min": 1000, "max": 50000}))
one_check("val_length", "length(label) BETWEEN 20 AND 24", Check("label", "length", {"min": 20, "max": 24}))
one_check("val_pattern", "regexp_matches(label, '^(?:\\s+Item 1)')", Check("label", "pattern", {"pattern": r"\s+Item 1"}))
one_check("val_enum", "flag IN ('Yes', 'maybe')", Check("flag", "enum", {"values": ["Yes", "maybe"]}))
one_check("val_date_format", "try_strptime(tm, '%Y-%m-%d %H:%M:%S') IS NOT NULL", Check("tm", "date_format", {"format": "%Y-%m-%d %H:%M:%S"}))
one_check("val_currency", f"{P} IS NOT NULL", Check("price", "currency"))
one_check("val_custom", "length(price) % 2 = 0", Check("price", "custom", {"function": "even_length"}))
ck.register("even_length", lambda v, p: F.length(v) % 2 == 0)


@query(
    "val_email",
    """
SELECT customer_id, regexp_matches(CASE WHEN customer_id % 3 = 0 THEN name ELSE email END, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') AS ok FROM clients""",
)
def _(t):
    c = t.clients.withColumn("mail", F.when(F.col("customer_id") % 3 == 0, F.col("name")).otherwise(F.col("email")))
    return c.select("customer_id", passes(Check("mail", "email"), c.columns).alias("ok"))


@query(
    "val_phone",
    r"""
WITH x AS (SELECT customer_id, CASE WHEN customer_id % 4 = 0 THEN '0' || phone WHEN customer_id % 4 = 1 THEN '(' || phone || ') 1' ELSE phone END AS p FROM clients)
SELECT customer_id, regexp_matches(regexp_replace(p, '[^\d\+]', '', 'g'), '^[\+]?[1-9][\d]{0,15}$') AS ok FROM x""",
)
def _(t):
    k = F.col("customer_id")
    c = t.clients.withColumn("p", F.when(k % 4 == 0, F.concat(F.lit("0"), "phone")).when(k % 4 == 1, F.concat(F.lit("("), "phone", F.lit(") 1"))).otherwise(F.col("phone")))
    return c.select("customer_id", passes(Check("p", "phone"), c.columns).alias("ok"))


CONTRACT = {
    "required": ["o_orderkey", "o_orderpriority"],
    "properties": {
        "o_totalprice": {"type": "number", "minimum": 5000, "maximum": 400000},
        "o_orderstatus": {"type": "string", "enum": ["F", "O"]},
        "o_orderpriority": {"type": "string", "pattern": "^[1-4]-"},
    },
}


@query(
    "val_json_schema",
    """
SELECT o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'o_orderkey:required' WHEN trim(o_orderpriority) = '' THEN 'o_orderpriority:required'
  WHEN o_totalprice NOT BETWEEN 5000 AND 400000 THEN 'o_totalprice:range' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus:enum'
  WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-') THEN 'o_orderpriority:custom' END AS first_error FROM orders""",
)
def _(t):
    return t.orders.select("o_orderkey", ck.first_error(ck.json_schema_checks(CONTRACT), t.orders.columns).alias("first_error"))


# A point-of-sale record per line with a declared total.
POS_SQL = """pos AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_orderkey AS VARCHAR) AS order_id, CASE WHEN l_partkey % 19 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS item_id,
  CASE WHEN l_partkey % 23 = 0 THEN '1200' WHEN l_partkey % 29 = 0 THEN '2.5' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS quantity,
  CASE WHEN l_partkey % 31 = 0 THEN 'free' ELSE CAST(CAST(l_partkey % 90 + 10 AS BIGINT) AS VARCHAR) END AS price,
  CASE WHEN l_linenumber = 7 THEN 'noon' ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS sale_time,
  CAST(CAST(l_quantity AS BIGINT) * (l_partkey % 90 + 10) + CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS total_amount FROM lineitem),
num AS (SELECT *, coalesce(TRY_CAST(quantity AS DOUBLE), 0) AS q, coalesce(TRY_CAST(price AS DOUBLE), 0) AS p, coalesce(TRY_CAST(total_amount AS DOUBLE), 0) AS t FROM pos),
errs AS (SELECT k, n, list_filter([CASE WHEN item_id IS NULL THEN 'item_id:required' END, CASE WHEN NOT regexp_matches(quantity, '^[0-9]+$') THEN 'quantity:type' END,
  CASE WHEN NOT (q BETWEEN 1 AND 1000) THEN 'quantity:range' END, CASE WHEN TRY_CAST(price AS DOUBLE) IS NULL THEN 'price:type' END,
  CASE WHEN TRY_CAST(price AS DOUBLE) IS NULL OR NOT p BETWEEN 0 AND 10000 THEN 'price:range' END, CASE WHEN sale_time = 'noon' THEN 'sale_time:date_format' END,
  CASE WHEN abs(t - q * p) > 0.01 THEN 'total_amount:business_logic' END, CASE WHEN q > 1000 THEN 'quantity:business_logic' END], lambda x: x IS NOT NULL) AS e FROM num)"""


def pos_records(t):
    p, s = F.col("l_partkey"), lambda c: c.cast("string")
    q = F.col("l_quantity").cast("long")
    return t.lineitem.select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("n"),
        s(F.col("l_orderkey")).alias("order_id"),
        F.when(p % 19 != 0, s(p)).alias("item_id"),
        F.when(p % 23 == 0, "1200").when(p % 29 == 0, "2.5").otherwise(s(q)).alias("quantity"),
        F.when(p % 31 == 0, "free").otherwise(s(p % 90 + 10)).alias("price"),
        F.when(F.col("l_linenumber") == 7, "noon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("sale_time"),
        s(q * (p % 90 + 10) + F.when(F.col("l_suppkey") % 10 == 0, 1).otherwise(0)).alias("total_amount"),
    )


@query("val_sales_logic", f"WITH {POS_SQL} SELECT k, n, abs(t - q * p) > 0.01 AS bad_total, q > 1000 AS high_quantity FROM num")
def _(t):
    (total, *_), (quantity, *_) = ck.sales_logic()
    return pos_records(t).select("k", "n", total.alias("bad_total"), quantity.alias("high_quantity"))


@query("val_inventory_logic", "SELECT product_id, stock_quantity - 10 < 0 AS negative FROM stock")
def _(t):
    s = t.stock.withColumn("current_stock", F.col("stock_quantity") - 10)
    return s.select("product_id", ck.inventory_logic()[0][0].alias("negative"))


@query("val_staff_logic", "SELECT staff_id, CAST(shift_date AS VARCHAR) AS shift_date, hours_worked + 6 > 16 AS too_long FROM shifts")
def _(t):
    s = t.shifts.withColumn("hours_worked", F.col("hours_worked") + 6)
    return s.select("staff_id", F.col("shift_date").cast("string").alias("shift_date"), ck.staff_logic()[0][0].alias("too_long"))


@query(
    "val_batch_summary",
    f"""
WITH {POS_SQL}, u AS (SELECT unnest(e) AS item FROM errs), b AS (SELECT item, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, item LIMIT 5)
SELECT 'total' AS section, 'total_records' AS item, count(*) AS n FROM errs UNION ALL SELECT 'total', 'valid_records', count(*) FROM errs WHERE len(e) = 0
UNION ALL SELECT 'total', 'invalid_records', count(*) FROM errs WHERE len(e) > 0 UNION ALL SELECT 'total', 'with_warnings', 0 UNION ALL SELECT 'errors', item, n FROM b""",
)
def _(t):
    return ck.batch_summary(ck.validate(pos_records(t), "pos"))


@query(
    "val_item_total",
    """
WITH i AS (SELECT sale_id, line_number, product_id, qty, CAST(line_total * 100 AS BIGINT) AS cents FROM sale_items),
p AS (SELECT *, (cents + qty - 1) // qty AS price FROM i)
SELECT sale_id, line_number, product_id, cents = qty * price - CASE WHEN line_number % 2 = 0 THEN qty * price - cents ELSE 0 END AS ok, count(*) AS n FROM p GROUP BY ALL""",
)
def _(t):
    # prices are rounded up to whole cents; every other line states the difference as its discount
    i = t.sale_items.withColumn("cents", (F.col("line_total") * 100).cast("long")).withColumn("price", F.expr("(cents + qty - 1) div qty"))
    discount = F.when(F.col("line_number") % 2 == 0, F.col("qty") * F.col("price") - F.col("cents"))
    ok = ck.item_total_ok(F.col("qty"), F.col("price"), F.col("cents"), discount)
    return i.groupBy("sale_id", "line_number", "product_id", ok.alias("ok")).agg(F.count("*").alias("n"))


@query(
    "val_sale_total",
    """
WITH i AS (SELECT sale_id, count(*) AS n, sum(line_total) AS items FROM sale_items GROUP BY 1),
s AS (SELECT sales.sale_id, coalesce(n, 0) AS n, items, CASE WHEN sales.sale_id % 2 = 0 THEN 1.50 END AS discount, sales.sale_id % 7 AS tax, amount FROM sales LEFT JOIN i USING (sale_id)),
c AS (SELECT *, CASE sale_id % 4 WHEN 0 THEN amount WHEN 1 THEN items - coalesce(discount, 0) + tax + 0.01 WHEN 2 THEN items - coalesce(discount, 0) + tax + 0.02 ELSE items - coalesce(discount, 0) + tax END AS total FROM s)
SELECT sale_id, n > 0 AS has_items, coalesce(n > 0 AND abs(total - (items - coalesce(discount, 0) + tax)) <= 0.01, false) AS ok FROM c""",
)
def _(t):
    items = t.sale_items.groupBy("sale_id").agg(F.count("*").alias("n"), F.sum("line_total").alias("items"))
    tax, discount = F.col("sale_id") % 7, F.when(F.col("sale_id") % 2 == 0, F.lit("1.50").cast("decimal(4,2)"))
    due = F.col("items") - F.coalesce(discount, F.lit(0)) + tax
    # stated totals: the order's own, and the due one with small deviations
    turn = F.col("sale_id") % 4
    total = F.when(turn == 0, F.col("amount")).when(turn == 1, due + F.lit("0.01").cast("decimal(4,2)")).when(turn == 2, due + F.lit("0.02").cast("decimal(4,2)")).otherwise(due)
    n = F.coalesce("n", F.lit(0))
    return t.sales.join(items, "sale_id", "left").select("sale_id", (n > 0).alias("has_items"), ck.sale_total_ok(n, F.col("items"), total, discount, tax).alias("ok"))


@query(
    "val_shift",
    "SELECT staff_id, CAST(shift_date AS VARCHAR) AS shift_date, hours_worked - 6 > 0 AND feedback + 0.5 <= 5 AS ok FROM shifts",
)
def _(t):
    # shifts of up to six hours are turned into ones that end no later than they start
    start = F.col("shift_date").cast("timestamp")
    end = start + F.make_interval(hours=(F.col("hours_worked") - 6).cast("int"))
    return t.shifts.select("staff_id", F.col("shift_date").cast("string").alias("shift_date"), ck.shift_ok(start, end, F.col("feedback") + 0.5).alias("ok"))


@query(
    "val_bulk_stock",
    "SELECT event_id, CAST(props->>'$.k' AS BIGINT) % 9 <> 0 AND event_id % 10 <> 0 AND CAST(value - 20 AS DECIMAL(18,2)) >= 0 AS ok FROM events",
)
def _(t):
    k = F.get_json_object("props", "$.k").cast("long")
    quantity = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise((F.col("value") - 20).cast("decimal(18,2)").cast("string"))
    return t.events.select("event_id", ck.stock_update_ok(F.when(k % 9 != 0, k), quantity).alias("ok"))


@query("val_date_range", "SELECT product_id, product_id % 5 = 0 OR expiry_date >= (SELECT max(sale_date) FROM sales) AS ok FROM stock")
def _(t):
    end = F.when(F.col("product_id") % 5 != 0, F.col("expiry_date"))
    return t.stock.select("product_id", ck.date_range_ok(t.sales.agg(F.max("sale_date").alias("m")).scalar(), end).alias("ok"))


@query(
    "val_role_branch",
    """
WITH u AS (SELECT s_suppkey AS user_id, CASE s_suppkey % 4 WHEN 0 THEN 'super_admin' WHEN 1 THEN 'analyst' WHEN 2 THEN 'manager' ELSE 'staff' END AS role, CASE WHEN s_nationkey % 3 <> 0 THEN s_nationkey END AS b FROM supplier)
SELECT user_id, CASE WHEN role IN ('manager', 'staff') THEN coalesce(b, 0) <> 0 ELSE coalesce(b, 0) = 0 END AS ok FROM u""",
)
def _(t):
    k = F.col("s_suppkey") % 4
    role = F.when(k == 0, "super_admin").when(k == 1, "analyst").when(k == 2, "manager").otherwise("staff")
    branch = F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey"))
    return t.supplier.select(F.col("s_suppkey").alias("user_id"), ck.role_branch_ok(role, branch).alias("ok"))


@query(
    "val_chart_rows",
    f"WITH {LOOSE_SQL} SELECT count(*) AS rows, count(*) FILTER (trim(price) = '' OR tm IS NULL) AS incomplete, count(*) > 0 AND count(*) FILTER (trim(price) = '' OR tm IS NULL) = 0 AS valid FROM loose",
)
def _(t):
    return ck.chart_rows(loose(t), F.col("tm"), F.col("price"))
