"""Row security and permissions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What each role may do, and who may do what on a resource.
ROLES = {
    "SUPER_ADMIN": (["*"], ["*"]),
    "SECURITY_ADMIN": (["users", "audit_logs", "security_config", "encryption_keys"], ["read", "create", "update", "delete"]),
    "ETL_ADMIN": (["etl_jobs", "data_sources", "warehouses", "dq_rules"], ["read", "create", "update", "delete", "execute"]),
    "MANAGER": (["dashboards", "reports", "analytics", "users"], ["read", "create", "update"]),
    "ANALYST": (["dashboards", "reports", "analytics"], ["read", "create", "update"]),
    "STAFF": (["dashboards", "reports"], ["read"]),
    "VIEWER": (["dashboards"], ["read"]),
}
RESOURCE_ROLES = {
    ("users", "create"): ["SUPER_ADMIN", "SECURITY_ADMIN", "MANAGER"],
    ("users", "read"): ["SUPER_ADMIN", "SECURITY_ADMIN", "MANAGER", "ANALYST"],
    ("users", "update"): ["SUPER_ADMIN", "SECURITY_ADMIN", "MANAGER"],
    ("users", "delete"): ["SUPER_ADMIN", "SECURITY_ADMIN"],
    ("audit_logs", "read"): ["SUPER_ADMIN", "SECURITY_ADMIN"],
    ("audit_logs", "export"): ["SUPER_ADMIN", "SECURITY_ADMIN"],
    ("dashboards", "create"): ["SUPER_ADMIN", "MANAGER", "ANALYST"],
    ("dashboards", "read"): ["*"],
    ("dashboards", "update"): ["SUPER_ADMIN", "MANAGER", "ANALYST"],
    ("dashboards", "delete"): ["SUPER_ADMIN", "MANAGER"],
    ("reports", "create"): ["SUPER_ADMIN", "MANAGER", "ANALYST"],
    ("reports", "read"): ["SUPER_ADMIN", "MANAGER", "ANALYST", "STAFF"],
    ("reports", "update"): ["SUPER_ADMIN", "MANAGER", "ANALYST"],
    ("reports", "delete"): ["SUPER_ADMIN", "MANAGER"],
    ("reports", "export"): ["SUPER_ADMIN", "MANAGER", "ANALYST"],
    ("etl_jobs", "create"): ["SUPER_ADMIN", "ETL_ADMIN"],
    ("etl_jobs", "read"): ["SUPER_ADMIN", "ETL_ADMIN", "MANAGER"],
    ("etl_jobs", "update"): ["SUPER_ADMIN", "ETL_ADMIN"],
    ("etl_jobs", "delete"): ["SUPER_ADMIN", "ETL_ADMIN"],
    ("etl_jobs", "execute"): ["SUPER_ADMIN", "ETL_ADMIN"],
    ("dq_rules", "create"): ["SUPER_ADMIN", "ETL_ADMIN"],
    ("dq_rules", "read"): ["SUPER_ADMIN", "ETL_ADMIN", "MANAGER"],
    ("dq_rules", "update"): ["SUPER_ADMIN", "ETL_ADMIN"],
    ("dq_rules", "delete"): ["SUPER_ADMIN", "ETL_ADMIN"],
    ("pii_data", "read"): ["SUPER_ADMIN"],
    ("pii_data", "export"): ["SUPER_ADMIN"],
}


def matrix() -> list[tuple[str, str, str]]:
    """All allowed (role, resource, action) triples. A role that lists a
    resource is decided by its own actions; otherwise the resource decides."""
    resources = sorted({r for r, _ in RESOURCE_ROLES} | {r for rs, _ in ROLES.values() for r in rs if r != "*"})
    actions = sorted({a for _, a in RESOURCE_ROLES} | {a for _, acts in ROLES.values() for a in acts if a != "*"})
    out = []
    for role, (own, acts) in ROLES.items():
        for resource, action in product(resources, actions):
            if "*" in own and "*" in acts:
                ok = True
            elif resource in own:
                ok = action in acts or "*" in acts
            else:
                roles = RESOURCE_ROLES.get((resource, action), [])
                ok = role in roles or "*" in roles
            if ok:
                out.append((role, resource, action))
    return out


def matrix_frame(spark: SparkSession) -> DataFrame:
    """The matrix as a frame: at most a few hundred rows, fixed by the code."""
    return spark.createDataFrame(matrix(), "role string, resource string, action string")


def permitted(requests: DataFrame) -> DataFrame:
    """Add ``allowed`` to rows with role, resource and action."""
    allowed = matrix_frame(requests.sparkSession).withColumn("_ok", F.lit(True))
    return requests.join(F.broadcast(allowed), ["role", "resource", "action"], "left").withColumn(
        "allowed", F.coalesce("_ok", F.lit(False))
    ).drop("_ok")


def effective_permissions(users: DataFrame) -> DataFrame:
    """Every (resource, action) a user holds; an equi join on the role."""
    return users.join(F.broadcast(matrix_frame(users.sparkSession)), "role")


def branch_rows(df: DataFrame, user: dict, branch: str = "branch_id", admin_view=False, own: str | None = None) -> DataFrame:
    """Rows a user may see. ``admin_view`` is the back-office variant:
    analysts see all branches, staff only their own rows."""
    role = user["role"]
    if role == "super_admin" or (admin_view and role == "analyst"):
        return df
    if user.get("branch_id") is None:
        return df.where(F.lit(False))
    rows = df.where(F.col(branch) == user["branch_id"])
    if admin_view and role == "staff" and own:
        rows = rows.where(F.col(own) == user["id"])
    return rows


def accessible(own: Column, allowed: Column, role: Column) -> Column:
    """List of branches of a user; ``ALL`` for super admins and users of ALL."""
    everything = (role == "SUPER_ADMIN") | (own == "ALL")
    return F.when(everything, F.array(F.lit("ALL"))).otherwise(
        F.array_distinct(F.array_compact(F.concat(F.array(own), F.coalesce(allowed, F.array().cast("array<string>")))))
    )


def rows_by_branch_list(df: DataFrame, users: DataFrame, branch: str = "branch_id") -> DataFrame:
    """Number of visible rows per user from row counts per branch, so that the
    fact table is read once and never paired with users."""
    counts = df.groupBy(F.col(branch).cast("string").alias("b")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).scalar()
    listed = users.withColumn("b", F.explode(accessible(F.col("own"), F.col("allowed"), F.col("role"))))
    return (
        listed.join(counts, "b", "left")
        .groupBy("user_id")
        .agg(F.max(F.when(F.col("b") == "ALL", True)).alias("all_"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        .select("user_id", F.when(F.col("all_"), total).otherwise(F.col("n")).alias("visible_rows"))
    )


def customer_rows(df: DataFrame, branches: list[int]) -> DataFrame:
    return df.where(F.col("preferred_branch").isin(*branches) | F.col("preferred_branch").isNull())


def own_rows(df: DataFrame, user: dict, owner: str) -> DataFrame:
    return df.where(F.col(owner) == user["id"]) if user["role"] == "staff" else df


def policy(
    hour: Column, business_hours: Column, sensitivity: Column, clearance: Column, owner: Column, user: Column,
    department: Column, user_department: Column, role: Column,
) -> Column:
    """Attribute policy: business hours, clearance, owner, department, in this order."""
    return (
        F.when(business_hours & ~hour.between(9, 17), False)
        .when((sensitivity == "HIGH") & (F.coalesce(clearance, F.lit("LOW")) != "HIGH"), False)
        .when(owner == user, True)
        .when((department != user_department) & ~role.isin("SUPER_ADMIN", "MANAGER"), False)
        .otherwise(True)
    )
