"""List filters, search and named periods, as Column predicates.

All predicates are plain expressions over the table's own columns, so they
reach the Parquet scan wherever the column is stored.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.columns import all_of, any_of, col


def icontains(c: str | Column, term: str) -> Column:
    return F.lower(col(c)).contains(term.lower())


def between(c: str | Column, low=None, high=None) -> list[Column]:
    out = []
    if low is not None:
        out.append(col(c) >= low)
    if high is not None:
        out.append(col(c) <= high)
    return out


# What each list view can filter: argument name -> (kind, column).
BRANCH = {"name": ("icontains", "branch_name"), "city": ("icontains", "city"), "country": ("icontains", "country"),
          "manager": ("icontains", "manager_name"), "is_active": ("eq", "is_active"), "created": ("range", "created")}
SALES = {"branch": ("eq", "branch_id"), "branch_name": ("icontains", "branch_name"), "date": ("range", "sale_date"),
         "payment_method": ("eq", "payment_method"), "order_type": ("eq", "order_type"), "customer": ("eq", "customer_id"),
         "server": ("eq", "staff_id"), "amount": ("range", "amount"), "is_active": ("eq", "is_active")}
INVENTORY = {"branch": ("eq", "branch_id"), "item_name": ("icontains", "item_name"), "category": ("eq", "category"),
             "supplier": ("icontains", "brand"), "stock": ("range", "stock_quantity"), "cost": ("range", "unit_cost"),
             "expiry": ("range", "expiry_date"), "is_active": ("eq", "is_active")}
CUSTOMER = {"name": ("icontains", "name"), "email": ("icontains", "email"), "phone": ("icontains", "phone"),
            "preferred_branch": ("eq", "preferred_branch"), "points": ("range", "loyalty_points"),
            "spent": ("range", "total_spent"), "visits": ("range", "visit_count"), "last_visit": ("range", "last_visit"),
            "is_active": ("eq", "is_active")}
STAFF = {"staff": ("eq", "staff_id"), "branch": ("eq", "branch_id"), "date": ("range", "shift_date"),
         "hours": ("range", "hours_worked"), "sales": ("range", "sales_generated"), "feedback": ("range", "feedback")}
DQ_RULE = {"check_type": ("eq", "check_type"), "severity": ("in", "severity"), "enabled": ("eq", "enabled"), "target": ("eq", "target")}
USER = {"role": ("eq", "role"), "branch": ("eq", "branch_id"), "is_active": ("eq", "is_active")}
LOG = {"user": ("eq", "user_id"), "ip": ("eq", "ip"), "action": ("eq", "action")}
AUDIT = {"action": ("eq", "action"), "severity": ("eq", "severity"), "user": ("eq", "user_id"), "resource_type": ("eq", "resource_type"),
         "success": ("eq", "success"), "time": ("range", "ts"), "correlation": ("eq", "correlation_id")}


def by_fields(df: DataFrame, fields: dict, **values) -> DataFrame:
    """Apply the given filter values; ranges are ``(low, high)`` with None for open."""
    conditions = []
    for name, value in values.items():
        kind, column = fields[name]
        if kind == "icontains":
            conditions.append(icontains(column, value))
        elif kind == "range":
            conditions += between(column, *value)
        elif kind == "in":
            conditions.append(F.col(column).isin(*value))
        else:
            conditions.append(F.col(column) == value)
    return df.where(all_of(conditions))


def low_stock() -> Column:
    return F.col("stock_quantity") <= F.col("reorder_level")


def expired(today: Column) -> Column:
    return F.col("expiry_date") < today


def search(df: DataFrame, columns: list[str], term: str) -> DataFrame:
    return df.where(any_of([icontains(c, term) for c in columns]))


def soft_delete(df: DataFrame, which: Column, now: Column) -> DataFrame:
    """Mark rows inactive and stamp them; rows already inactive stay."""
    hit = which & F.col("is_active")
    stamped = F.when(hit, now)
    if "updated_at" in df.columns:
        stamped = stamped.otherwise(F.col("updated_at"))
    return df.withColumns({"is_active": F.col("is_active") & ~hit, "updated_at": stamped})


PERIODS = ("last_7_days", "last_30_days", "last_90_days", "this_month", "last_month", "this_year")


def in_period(day: str | Column, period: str, as_of: Column) -> Column:
    d = col(day)
    if period.startswith("last_") and period.endswith("_days"):
        return (d >= F.date_sub(as_of, int(period.split("_")[1]))) & (d <= as_of)
    if period == "this_month":
        return (d >= F.trunc(as_of, "month")) & (d <= as_of)
    if period == "last_month":
        return (d >= F.add_months(F.trunc(as_of, "month"), -1)) & (d < F.trunc(as_of, "month"))
    if period == "this_year":
        return (d >= F.trunc(as_of, "year")) & (d <= as_of)
    raise ValueError(f"unknown period {period}")


def log_time_range(ts: str | Column, spec: str) -> Column:
    """``a,b`` dates: later than a and before the end of b; anything that is
    not two dates, and rows without a time, stay."""
    try:
        a, b = (datetime.strptime(p.strip(), "%Y-%m-%d").date() for p in spec.split(","))
    except ValueError:
        return F.lit(True)
    t = col(ts)
    # written without a coalesce, so that it reaches the file statistics
    return t.isNull() | ((t > F.lit(a).cast("timestamp")) & (t < F.lit(b + timedelta(days=1)).cast("timestamp")))


def newest(df: DataFrame, ts: str, tie: str, limit: int = 100) -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(limit)


def segment() -> Column:
    """Customer segment; frequent visitors are flagged apart."""
    spent = F.col("total_spent")
    return F.when(spent >= 1000, "gold").when(spent >= 500, "silver").otherwise("standard")


# Request patterns that count as suspicious.
SUSPICIOUS = {
    "injection": r"(?i)(union\s+select|script\s*>|javascript:|vbscript:)",
    "traversal": r"(?i)(\.\.\/|\.\.\\)",
    "markup": r"(?i)(<script|<iframe|<object)",
    "code": r"(?i)(eval\s*\(|expression\s*\()",
}


def suspicious_locations(parts: dict[str, Column]) -> Column:
    """Names of the request parts that match any pattern."""
    hits = [
        F.when(any_of([c.rlike(p) for p in SUSPICIOUS.values()]), F.lit(name)) for name, c in parts.items()
    ]
    return F.array_compact(F.array(*hits))
