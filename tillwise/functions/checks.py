"""Validation rules as Column predicates.

``errors(...)`` turns a rule list into one array of error structs, so a record
is checked in a single projection whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.columns import all_of, any_of
from tillwise.functions.times import parse

# Formats a value must have.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^[\+]?[1-9][\d]{0,15}$"
BOOL_WORDS = ("true", "false", "1", "0", "yes", "no")


@dataclass(frozen=True)
class Check:
    field: str
    kind: str
    params: dict = field(default_factory=dict)
    message: str = ""
    severity: str = "error"


def _num(v: Column) -> Column:
    return F.trim(v.cast("string")).try_cast("double")


def required(v: Column, p: dict) -> Column:
    return v.isNotNull() & (F.trim(v.cast("string")) != "")


def of_type(v: Column, p: dict) -> Column:
    s = v.cast("string")
    kind = p["type"]
    if kind == "int":
        return s.rlike(r"^\s*[+-]?\d+\s*$")
    if kind in ("float", "decimal"):
        return _num(s).isNotNull()
    if kind == "str":
        return F.lit(True)
    if kind == "bool":
        return F.lower(s).isin(*BOOL_WORDS)
    if kind == "date":
        return parse(s, p.get("format", "%Y-%m-%d")).isNotNull()
    return F.lit(False)


def in_range(v: Column, p: dict) -> Column:
    n = _num(v)
    ok = [n.isNotNull()]
    if p.get("min") is not None:
        ok.append(n >= p["min"])
    if p.get("max") is not None:
        ok.append(n <= p["max"])
    return F.coalesce(all_of(ok), F.lit(False))


def length(v: Column, p: dict) -> Column:
    n = F.length(v.cast("string"))
    ok = [n >= p.get("min", 0)]
    if p.get("max") is not None:
        ok.append(n <= p["max"])
    return all_of(ok)


def pattern(v: Column, p: dict) -> Column:
    """Anchored at the start only."""
    return v.cast("string").rlike(f"^(?:{p['pattern']})")


def one_of(v: Column, p: dict) -> Column:
    return v.isin(*p["values"])


def date_format(v: Column, p: dict) -> Column:
    return parse(v.cast("string"), p.get("format", "%Y-%m-%d")).isNotNull()


def currency(v: Column, p: dict) -> Column:
    return _num(F.translate(v.cast("string"), "$,", "")).isNotNull()


def email(v: Column, p: dict) -> Column:
    return v.cast("string").rlike(EMAIL)


def phone(v: Column, p: dict) -> Column:
    return F.regexp_replace(v.cast("string"), r"[^\d\+]", "").rlike(PHONE)


CUSTOM: dict[str, Callable[[Column, dict], Column]] = {}


def register(name: str, fn: Callable[[Column, dict], Column]) -> None:
    CUSTOM[name] = fn


def custom(v: Column, p: dict) -> Column:
    if p["function"] not in CUSTOM:
        raise ValueError(f"no custom check {p['function']}")
    return CUSTOM[p["function"]](v, p)


CHECKS: dict[str, Callable[[Column, dict], Column]] = {
    "required": required, "type": of_type, "range": in_range, "length": length, "pattern": pattern, "enum": one_of,
    "date_format": date_format, "currency": currency, "email": email, "phone": phone, "custom": custom,
}


def passes(check: Check, columns: list[str]) -> Column:
    """True where the check holds; null passes all but ``required``."""
    if check.kind not in CHECKS:
        return F.lit(False)
    v = F.col(check.field) if check.field in columns else F.lit(None).cast("string")
    ok = F.coalesce(CHECKS[check.kind](v, check.params), F.lit(False))
    return ok if check.kind == "required" else v.isNull() | ok


def _entry(field_: str, rule: str, message: Column | str, value: Column) -> Column:
    m = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(field_).alias("field"), F.lit(rule).alias("rule"), m.alias("message"), value.cast("string").alias("value")
    )


ENTRIES = "array<struct<field:string,rule:string,message:string,value:string>>"


def _gather(entries: list[tuple[Column, Column]], kind: str = ENTRIES) -> Column:
    """Array of the entries whose condition holds. A concatenation of short
    arrays stays in generated code; a higher-order function would evaluate all
    checks row by row in interpreted mode."""
    none = F.array().cast(kind)
    if not entries:
        return none
    return F.concat(*[F.when(F.coalesce(hit, F.lit(False)), F.array(entry).cast(kind)).otherwise(none) for hit, entry in entries])


def failures(checks: list[Check], columns: list[str], severity: str) -> list[tuple[Column, Column, str]]:
    """(failed, entry, key) of the checks of one severity."""
    return [
        (
            ~passes(c, columns),
            _entry(c.field, c.kind, c.message, F.col(c.field) if c.field in columns else F.lit(None)),
            f"{c.field}:{c.kind}",
        )
        for c in checks
        if c.severity == severity
    ]


Logic = list[tuple[Column, Column, str]]


def sales_logic() -> Logic:
    """Total within a cent of quantity times price; quantity at most 1000."""
    q, p, t = (F.coalesce(_num(F.col(c)), F.lit(0.0)) for c in ("quantity", "price", "total_amount"))
    return [
        (F.abs(t - q * p) > 0.01, _entry("total_amount", "business_logic", "total differs from quantity times price", t), "total_amount:business_logic"),
        (q > 1000, _entry("quantity", "business_logic", "unusually high quantity", q), "quantity:business_logic"),
    ]


def inventory_logic() -> Logic:
    s = _num(F.col("current_stock"))
    return [(s < 0, _entry("current_stock", "business_logic", "stock cannot be negative", s), "current_stock:business_logic")]


def staff_logic() -> Logic:
    h = _num(F.col("hours_worked"))
    return [(h > 16, _entry("hours_worked", "business_logic", "unusually high work hours", h), "hours_worked:business_logic")]


LOGIC = {"pos": sales_logic, "api_sales": sales_logic, "inventory": inventory_logic, "staff": staff_logic}

# Default checks per source.
DEFAULT_CHECKS = {
    "pos": [
        Check("order_id", "required", {}, "Order ID is required"),
        Check("item_id", "required", {}, "Item ID is required"),
        Check("quantity", "type", {"type": "int"}, "Quantity must be an integer"),
        Check("quantity", "range", {"min": 1, "max": 1000}, "Quantity must be between 1 and 1000"),
        Check("price", "type", {"type": "decimal"}, "Price must be a valid decimal"),
        Check("price", "range", {"min": 0, "max": 10000}, "Price must be between 0 and 10000"),
        Check("sale_time", "date_format", {"format": "%Y-%m-%d %H:%M:%S"}, "Invalid sale time format"),
    ],
    "csv_upload": [Check("uploaded_at", "required", {}, "Upload timestamp is required")],
    "api": [Check("timestamp", "required", {}, "Timestamp is required")],
}


def json_schema_checks(schema: dict, prefix: str = "") -> list[Check]:
    """Checks of a declared contract: required, type, enum, bounds, pattern."""
    kinds = {"integer": "int", "number": "float", "string": "str", "boolean": "bool"}
    out = [Check(f, "required", {}, f"'{f}' is a required property") for f in schema.get("required", [])]
    for name, spec in schema.get("properties", {}).items():
        if spec.get("type") in kinds:
            out.append(Check(name, "type", {"type": kinds[spec["type"]]}, f"{name} is not of type {spec['type']}"))
        if "enum" in spec:
            out.append(Check(name, "enum", {"values": spec["enum"]}, f"{name} is not one of the allowed values"))
        if "minimum" in spec or "maximum" in spec:
            out.append(Check(name, "range", {"min": spec.get("minimum"), "max": spec.get("maximum")}, f"{name} is out of bounds"))
        if "minLength" in spec or "maxLength" in spec:
            out.append(Check(name, "length", {"min": spec.get("minLength", 0), "max": spec.get("maxLength")}, f"{name} has a bad length"))
        if "pattern" in spec:
            out.append(Check(name, "custom", {"function": "search", "pattern": spec["pattern"]}, f"{name} does not match"))
    return out


register("search", lambda v, p: v.cast("string").rlike(p["pattern"]))


def first_error(checks: list[Check], columns: list[str]) -> Column:
    """``field:rule`` of the first failed check."""
    return F.coalesce(*[F.when(~passes(c, columns), F.lit(f"{c.field}:{c.kind}")) for c in checks])


def validate(df: DataFrame, source: str, checks: list[Check] | None = None) -> DataFrame:
    """Add ``is_valid``, the ``errors`` and ``warnings`` arrays and their keys
    (``field:rule``).

    Each is its own expression over the record, so a query builds only what it
    reads: keeping the valid rows makes no error list.
    """
    rules = DEFAULT_CHECKS.get(source, []) if checks is None else checks
    bad = failures(rules, df.columns, "error") + (LOGIC[source]() if source in LOGIC else [])
    odd = failures(rules, df.columns, "warning")
    return df.withColumns(
        {
            "is_valid": ~any_of([F.coalesce(hit, F.lit(False)) for hit, _, _ in bad]),
            "errors": _gather([(hit, entry) for hit, entry, _ in bad]),
            "warnings": _gather([(hit, entry) for hit, entry, _ in odd]),
            "error_keys": _gather([(hit, F.lit(key)) for hit, _, key in bad], "array<string>"),
            "warning_keys": _gather([(hit, F.lit(key)) for hit, _, key in odd], "array<string>"),
        }
    )


def batch_summary(checked: DataFrame, top: int = 5) -> DataFrame:
    """Counts and the most common errors and warnings as rows, from one pass.

    Records are counted by their pair of key lists first; there are few
    different ones, and only these are unfolded into labels.
    """
    kinds = checked.groupBy("error_keys", "warning_keys").agg(F.count("*").alias("n"))

    def keyed(name: str, section: str) -> Column:
        return F.transform(name, lambda k: F.concat(F.lit(section + "/"), k))

    valid = F.when(F.size("error_keys") == 0, "total/valid_records").otherwise("total/invalid_records")
    warned = F.when(F.size("warning_keys") > 0, F.array(F.lit("total/with_warnings"))).otherwise(F.array().cast("array<string>"))
    labels = F.concat(F.array(F.lit("total/total_records"), valid), warned, keyed("error_keys", "errors"), keyed("warning_keys", "warnings"))
    counts = kinds.select(F.explode(labels).alias("label"), "n").groupBy("label").agg(F.sum("n").alias("n"))
    named = counts.select(F.substring_index("label", "/", 1).alias("section"), F.substring_index("label", "/", -1).alias("item"), "n")
    totals = ["total_records", "valid_records", "invalid_records", "with_warnings"]
    head = named.where("section = 'total'").agg(*[F.coalesce(F.max(F.when(F.col("item") == x, F.col("n"))), F.lit(0)).alias(x) for x in totals])
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "item"))
    best = named.where("section <> 'total'").withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")
    return head.unpivot([], totals, "item", "n").select(F.lit("total").alias("section"), "item", "n").unionByName(best)


# --- rules over several fields of a business record --------------------------------


def item_total_ok(quantity: Column, unit_price: Column, total: Column, discount: Column | None = None) -> Column:
    """The line's total is quantity times price less discount (none: 0), exactly."""
    less = F.lit(0) if discount is None else F.coalesce(discount, F.lit(0))
    return F.coalesce(total == quantity * unit_price - less, F.lit(False))


def sale_total_ok(n_items: Column, item_sum: Column, total: Column, discount: Column, tax: Column, tolerance: str = "0.01") -> Column:
    """At least one item, and items less discount plus tax within the tolerance of the total."""
    zero = F.lit(0)
    expected = item_sum - F.coalesce(discount, zero) + F.coalesce(tax, zero)
    near = F.abs(total - expected) <= F.lit(tolerance).cast("decimal(18,4)")
    return F.coalesce((n_items > 0) & near, F.lit(False))


def shift_ok(start: Column, end: Column, feedback: Column) -> Column:
    """The shift ends after it starts; a feedback score lies between 0 and 5."""
    return F.coalesce(end > start, F.lit(False)) & F.coalesce(feedback.between(0, 5), F.lit(True))


def stock_update_ok(ident: Column, quantity: Column) -> Column:
    """An update names its record and a quantity that is a number and not negative."""
    return ident.isNotNull() & F.coalesce(quantity.try_cast("decimal(38,10)") >= 0, F.lit(False))


def date_range_ok(start: Column, end: Column) -> Column:
    """A range with both ends does not end before it starts."""
    return F.coalesce(start <= end, F.lit(True))


# Roles that must, and that must not, be tied to a branch.
BRANCH_ROLES, FREE_ROLES = ("manager", "staff"), ("super_admin", "analyst")


def role_branch_ok(role: Column, branch: Column) -> Column:
    tied = F.coalesce(branch != 0, F.lit(False))
    return F.when(role.isin(*BRANCH_ROLES), tied).when(role.isin(*FREE_ROLES), ~tied).otherwise(True)


def chart_rows(df: DataFrame, label: Column, value: Column) -> DataFrame:
    """Rows, rows without label or value, and whether a chart can be drawn from them."""
    gap = label.isNull() | (F.trim(label.cast("string")) == "") | value.isNull() | (F.trim(value.cast("string")) == "")
    return df.agg(F.count("*").alias("rows"), F.count_if(gap).alias("incomplete"), ((F.count("*") > 0) & (F.count_if(gap) == 0)).alias("valid"))
