"""Catalogue: row security and permissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.columns import dbl, text
from tillwise.operators import access
from tillwise.plans.joins import MATRIX_SQL, ROLE_SQL
from tillwise.plans.registry import query
from tillwise.plans.standins import recode


@query("acl_branch_rows", "SELECT sale_id, CAST(amount AS DOUBLE) AS amount FROM sales WHERE branch_id = 7")
def _(t):
    return access.branch_rows(t.sales, {"role": "manager", "branch_id": 7}).select("sale_id", dbl("amount").alias("amount"))


@query(
    "acl_branch_list",
    """
WITH u AS (SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 10 = 0 THEN 'ALL' ELSE CAST(s_nationkey AS VARCHAR) END AS own,
    [CAST(s_suppkey % 25 AS VARCHAR), CAST(s_suppkey % 6 AS VARCHAR)] AS allowed, CASE WHEN s_suppkey % 13 = 0 THEN 'SUPER_ADMIN' ELSE 'MANAGER' END AS role FROM supplier),
l AS (SELECT DISTINCT user_id, unnest(list_append(allowed, own)) AS b FROM u), c AS (SELECT CAST(branch_id AS VARCHAR) AS b, count(*) AS n FROM sales GROUP BY 1)
SELECT u.user_id, CASE WHEN role = 'SUPER_ADMIN' OR own = 'ALL' THEN (SELECT count(*) FROM sales) ELSE CAST((SELECT coalesce(sum(n), 0) FROM l JOIN c USING (b) WHERE l.user_id = u.user_id) AS BIGINT) END AS visible_rows FROM u""",
)
def _(t):
    k = F.col("s_suppkey")
    users = t.supplier.select(
        k.alias("user_id"),
        F.when(k % 10 == 0, "ALL").otherwise(text("s_nationkey")).alias("own"),
        F.array(text(k % 25), text(k % 6)).alias("allowed"),
        F.when(k % 13 == 0, "SUPER_ADMIN").otherwise("MANAGER").alias("role"),
    )
    return access.rows_by_branch_list(t.sales, users)


@query(
    "acl_customer_rows",
    "SELECT customer_id, preferred_branch FROM clients WHERE preferred_branch IN (3, 8) OR preferred_branch IS NULL",
)
def _(t):
    return access.customer_rows(t.clients, [3, 8]).select("customer_id", "preferred_branch")


@query("acl_own_rows", "SELECT staff_id, CAST(shift_date AS VARCHAR) AS shift_date FROM shifts WHERE staff_id = 5")
def _(t):
    return access.own_rows(t.shifts, {"role": "staff", "id": 5}, "staff_id").select("staff_id", text("shift_date").alias("shift_date"))


@query(
    "acl_effective_permissions",
    f"""WITH {MATRIX_SQL}, u AS (SELECT user_id, {ROLE_SQL} AS role FROM (SELECT DISTINCT user_id FROM events))
SELECT user_id, u.role, resource, action FROM u JOIN matrix m ON u.role = m.role""",
)
def _(t):
    role = recode(text(F.col("user_id") % 7), {str(i): r for i, r in enumerate(access.ROLES)})
    return access.effective_permissions(t.events.select("user_id").distinct().withColumn("role", role))


@query(
    "acl_policy_eval",
    """
SELECT event_id, CASE WHEN event_id % 2 = 0 AND hour(ts) NOT BETWEEN 9 AND 17 THEN false
  WHEN severity = 'HIGH' AND user_id % 3 <> 0 THEN false WHEN user_id % 10 = event_id % 10 THEN true
  WHEN user_id % 4 <> event_id % 4 AND user_id % 5 <> 0 THEN false ELSE true END AS allowed FROM audit_events""",
)
def _(t):
    u, e = F.col("user_id"), F.col("event_id")
    allowed = access.policy(
        F.hour("ts"), e % 2 == 0, F.col("severity"), F.when(u % 3 == 0, "HIGH"), e % 10, u % 10, e % 4, u % 4,
        F.when(u % 5 == 0, "MANAGER").otherwise("ANALYST"),
    )
    return t.audit_events.select("event_id", allowed.alias("allowed"))
