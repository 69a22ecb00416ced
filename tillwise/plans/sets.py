"""Catalogue: set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.operators import sets
from tillwise.plans.registry import query


@query(
    "set_union_anomalies",
    """
SELECT 'errors' AS kind, user_id, count(*) AS n FROM log_entries WHERE level = 'ERROR' GROUP BY user_id
UNION ALL SELECT 'exports', user_id, count(*) FROM log_entries WHERE action LIKE '%export%' GROUP BY user_id""",
)
def _(t):
    def counted(kind, cond):
        return t.log_entries.where(cond).groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "user_id", "n")

    return sets.union_all([counted("errors", F.col("level") == "ERROR"), counted("exports", F.col("action").contains("export"))])


@query(
    "set_distinct_recipients",
    """
WITH r AS (SELECT customer_id, unnest([email, CASE WHEN customer_id % 3 = 0 THEN email ELSE segment END, 'admin' || CAST(branch_id AS VARCHAR) || '@example.com', 'pager']) AS a FROM clients)
SELECT customer_id, count(DISTINCT a) AS recipients FROM r WHERE a LIKE '%@%' GROUP BY 1""",
)
def _(t):
    owners = F.array("email", F.when(F.col("customer_id") % 3 == 0, F.col("email")).otherwise(F.col("segment")))
    admins = F.array(F.concat(F.lit("admin"), F.col("branch_id").cast("string"), F.lit("@example.com")), F.lit("pager"))
    return t.clients.select("customer_id", F.size(sets.recipients(owners, admins)).cast("long").alias("recipients"))


@query(
    "set_except_missing",
    "SELECT l_orderkey AS sale_id FROM lineitem EXCEPT SELECT sale_id FROM sales WHERE is_active",
)
def _(t):
    return sets.missing(t.lineitem.select(F.col("l_orderkey").alias("sale_id")), t.sales.where("is_active").select("sale_id"))


@query(
    "set_intersect_rules",
    "SELECT l_partkey AS product_id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT product_id FROM stock WHERE is_active",
)
def _(t):
    asked = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("product_id"))
    return sets.common(asked, t.stock.where("is_active").select("product_id"))


@query(
    "set_union_branches",
    """
WITH b AS (SELECT DISTINCT customer_id, b FROM (SELECT customer_id, unnest([branch_id, branch_id, CAST(customer_id % 25 AS INTEGER), CAST(customer_id % 7 AS INTEGER)]) AS b FROM clients))
SELECT customer_id, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS branches FROM b GROUP BY 1""",
)
def _(t):
    allowed = F.array((F.col("customer_id") % 25).cast("int"), (F.col("customer_id") % 7).cast("int"))
    return t.clients.select(
        "customer_id",
        F.array_join(F.array_sort(sets.branches(F.col("branch_id"), allowed)), ",").alias("branches"),
    )
