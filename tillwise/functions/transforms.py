"""Scalar transforms and the rule fold.

Every transform is ``(value, params, df columns) -> Column`` over built-in
expressions; a rule list folds into chained columns, which Catalyst collapses
into one projection. A value that cannot be transformed keeps its text where
the result is text; typed results are null instead.
"""

from __future__ import annotations

import ast
import re
import string
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.columns import any_of
from tillwise.functions.times import java_pattern, parse, standardize

TRUE_WORDS = ("true", "1", "yes", "y", "on")


@dataclass(frozen=True)
class Rule:
    source: str
    target: str
    kind: str
    params: dict = field(default_factory=dict)
    condition: str | None = None


def number(c: Column) -> Column:
    """Null and blank count as zero."""
    return F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(0.0))


def cast(v: Column, params: dict) -> Column:
    s = v.cast("string")
    kind = params["type"]
    if kind == "int":
        return F.trim(s).try_cast("double").try_cast("long")
    if kind == "float":
        return F.trim(s).try_cast("double")
    if kind == "decimal":
        return F.trim(s).try_cast(params.get("sql_type", "decimal(38,10)"))
    if kind == "str":
        return s
    if kind == "bool":
        return F.lower(s).isin(*TRUE_WORDS)
    if kind == "datetime":
        return s.try_cast("timestamp")
    raise ValueError(f"unknown type {kind}")


def fmt(v: Column, params: dict) -> Column:
    s = v.cast("string")
    kind = params["format_type"]
    if kind == "date":
        parsed = parse(s, params.get("input_format", "%Y-%m-%d"))
        return F.coalesce(F.date_format(parsed, java_pattern(params.get("format", "%Y-%m-%d"))), s)
    if kind == "number":
        pattern = params.get("format", f"%.{params.get('decimals', 2)}f")
        n = F.trim(s).try_cast("double")
        return F.when(n.isNotNull(), F.format_string(pattern, n)).otherwise(s)
    if kind == "string":
        return format_text(s, params.get("format") or "{}")
    return s


# Format marks of a text: fill, side, width and number of characters shown.
MARKS = re.compile(r"(?:(?P<fill>.)?(?P<side>[<>^]))?(?P<zero>0)?(?P<width>\d+)?(?:\.(?P<most>\d+))?s?", re.DOTALL)


def format_text(s: Column, pattern: str) -> Column:
    """The pattern with the value in its fields: ``{}`` once or ``{0}`` any number
    of times, each with marks of its own (``{0:*^12.5}``); ``{{`` and ``}}`` are
    braces. Marks for other types than text, conversions and further fields
    raise a ValueError."""
    parts, automatic = [], 0
    for literal, name, spec, conversion in string.Formatter().parse(pattern):
        parts.append(F.lit(literal))
        if name is None:
            continue
        automatic += name == ""
        m = MARKS.fullmatch(spec)
        if name not in ("", "0") or automatic > 1 or conversion not in (None, "s") or m is None:
            raise ValueError(f"a text can't be put into the format {pattern!r}")
        shown = s if m["most"] is None else F.left(s, F.lit(int(m["most"])))
        width = int(m["width"] or 0)
        fill = m["fill"] or ("0" if m["zero"] else " ")
        free = F.greatest(F.lit(width) - F.char_length(shown), F.lit(0))
        before = {">": free, "^": F.floor(free / 2).cast("int")}.get(m["side"], F.lit(0))
        pad = lambda n, c=fill: F.repeat(F.lit(c), n)
        parts.append(F.concat(pad(before), shown, pad(free - before)) if width else shown)
    return F.concat(*parts) if parts else F.when(s.isNotNull(), "")


def normalize(v: Column, params: dict) -> Column:
    s = v.cast("string")
    if params.get("trim", True):
        s = F.regexp_replace(s, r"^\s+|\s+$", "")
    if params.get("remove_extra_spaces", True):
        s = F.regexp_replace(s, r"\s+", " ")
    case = params.get("case")
    if case == "upper":
        s = F.upper(s)
    elif case == "lower":
        s = F.lower(s)
    elif case == "title":
        s = F.initcap(s)
    elif case == "sentence":
        s = F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substring(s, 2, 2147483647)))
    if params.get("remove_special_chars"):
        s = F.regexp_replace(s, f"[^{params.get('allowed_chars', 'a-zA-Z0-9 ')}]", "")
    return s


def extract(v: Column, params: dict) -> Column:
    s = v.cast("string")
    if "regex" in params:
        p = params["regex"]
        found = F.regexp_extract(s, p, params.get("group", 0))
        return F.when(s.rlike(p), found).otherwise(F.when(s.isNotNull(), F.lit(params.get("default", ""))))
    if "start" in params or "end" in params:
        return slice_text(s, params.get("start", 0), params.get("end"))
    return s


def slice_text(s: Column, start: int, end: int | None) -> Column:
    """Half-open character range; negative bounds count from the end."""
    n = F.length(s)

    def bound(i: int) -> Column:
        return F.least(F.lit(i), n) if i >= 0 else F.greatest(n + i, F.lit(0))

    a = bound(start)
    b = n if end is None else bound(end)
    return F.substring(s, a + 1, F.greatest(b - a, F.lit(0)))


def replace(v: Column, params: dict) -> Column:
    s = v.cast("string")
    steps = list(params.get("replacements", []))
    if "pattern" in params:
        steps.append({k: params[k] for k in ("pattern", "replace_with", "regex") if k in params})
    for step in steps:
        new = step.get("replace_with", "")
        if step.get("regex"):
            s = F.regexp_replace(s, step["pattern"], new)
        else:
            s = F.replace(s, F.lit(step["pattern"]), F.lit(new))
    return s


def formula(text: str, names: dict[str, Column]) -> Column:
    """Arithmetic over the given names; anything else is refused. A division
    by zero gives null."""
    ops = {
        ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b,
        ast.Div: F.try_divide, ast.Mod: lambda a, b: F.when(b != 0, a % b),
    }

    def walk(node) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in ops:
            return ops[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -walk(node.operand)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in names:
            return number(names[node.id])
        raise ValueError(f"formula not allowed: {text}")

    return walk(ast.parse(text, mode="eval").body)


def calculate(v: Column, params: dict, columns: list[str]) -> Column:
    op = params["operation"]
    a = number(v)
    if op == "multiply":
        return a * float(params.get("multiplier", 1))
    if op == "divide":
        by = float(params.get("divisor", 1))
        return a / by if by else F.lit(0.0)
    if op == "add":
        return a + float(params.get("addend", 0))
    if op == "subtract":
        return a - float(params.get("subtrahend", 0))
    if op == "percentage":
        name = params.get("total_field")
        total = number(F.col(name)) if name in columns else F.lit(1.0)
        return F.when(total != 0, a / total * 100).otherwise(0.0)
    if op == "formula":
        names = {c: F.col(c) for c in columns} | {"value": v}
        return F.coalesce(formula(params["formula"], names), a)
    raise ValueError(f"unknown operation {op}")


def lookup(v: Column, params: dict) -> Column:
    s = v.cast("string")
    table = params.get("table", {})
    other = F.lit(params["default"]) if params.get("default") is not None else s
    if not table:
        return other
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), s), other)


def lookup_table(df: DataFrame, field_: str, table: DataFrame, key: str, value: str, target: str) -> DataFrame:
    """Lookup in a table of any size: a left join, unknown keys keep the value."""
    t = table.select(F.col(key).cast("string").alias("_lk"), F.col(value).cast("string").alias("_lv"))
    return df.join(t, F.col(field_).cast("string") == F.col("_lk"), "left").withColumn(
        target, F.coalesce("_lv", F.col(field_).cast("string"))
    ).drop("_lk", "_lv")


def concatenate(v: Column, params: dict) -> Column:
    parts = [v, *[F.col(f) for f in params.get("fields", [])]]
    return F.concat_ws(params.get("separator", ""), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def split(v: Column, params: dict) -> Column:
    s = v.cast("string")
    parts = F.split(s, re.escape(params.get("separator", ",")), -1)
    i = params.get("index", 0)
    at = F.get(parts, F.lit(i)) if i >= 0 else F.get(parts, F.size(parts) + i)
    return F.when(s.isNotNull(), F.trim(F.coalesce(at, F.lit(""))))


def digest(v: Column, params: dict) -> Column:
    algorithm = params.get("algorithm", "sha256")
    s = v.cast("string")
    if algorithm == "sha256":
        return F.sha2(s, 256)
    if algorithm == "md5":
        return F.md5(s)
    raise ValueError(f"unknown algorithm {algorithm}")


def mask(v: Column, params: dict) -> Column:
    s = v.cast("string")
    ch = F.lit(params.get("mask_char", "*"))
    kind = params.get("type", "partial")
    n = F.length(s)
    if kind == "full":
        return F.repeat(ch, n)
    if kind == "partial":
        a, b = params.get("show_first", 2), params.get("show_last", 2)
        shown = F.concat(F.left(s, F.lit(a)), F.repeat(ch, n - a - b), F.right(s, F.lit(b)) if b else F.lit(""))
        return F.when(n <= a + b, F.repeat(ch, n)).otherwise(shown)
    if kind == "email":
        at = F.instr(s, "@")
        user = F.substring(s, F.lit(1), at - 1)
        hidden = F.concat(F.left(user, F.lit(1)), F.repeat(ch, F.length(user) - 1), F.substring(s, at, n))
        return F.when(at > 1, hidden).otherwise(s)
    raise ValueError(f"unknown mask {kind}")


TRANSFORMS: dict[str, Callable[[Column, dict], Column]] = {
    "cast": cast, "format": fmt, "normalize": normalize, "extract": extract, "replace": replace,
    "lookup": lookup, "concatenate": concatenate, "split": split, "encrypt": digest, "mask": mask,
}
CUSTOM: dict[str, Callable[[Column, dict], Column]] = {}


def register(name: str, fn: Callable[[Column, dict], Column]) -> None:
    """Add a user transform: a function of Columns or a pandas UDF."""
    CUSTOM[name] = fn


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Fold the rules in order; later rules see the results of earlier ones."""
    for r in rules:
        if r.source not in df.columns:
            continue
        v = F.col(r.source)
        if r.kind == "calculate":
            new = calculate(v, r.params, df.columns)
        elif r.kind == "custom":
            if r.params["function"] not in CUSTOM:
                raise ValueError(f"no custom transform {r.params['function']}")
            new = CUSTOM[r.params["function"]](v, r.params)
        else:
            new = TRANSFORMS[r.kind](v, r.params)
        target = r.target or r.source
        if r.condition:
            old = F.col(target) if target in df.columns else F.lit(None)
            new = F.when(F.coalesce(F.expr(r.condition), F.lit(False)), new).otherwise(old)
        df = df.withColumn(target, new)
    return df


METADATA = ("_source", "_processed_at", "_record_hash", "_transformation_error")


def record_hash(columns: list[str]) -> Column:
    """SHA-256 of the record as JSON with sorted field names, metadata left out."""
    names = sorted(c for c in columns if c not in METADATA)
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


def add_metadata(df: DataFrame, source: str) -> DataFrame:
    return df.withColumns(
        {"_record_hash": record_hash(df.columns), "_source": F.lit(source), "_processed_at": F.current_timestamp()}
    )


def pos(df: DataFrame) -> DataFrame:
    """Price without currency signs, line total and ISO sale time."""
    clean = F.translate(F.col("price").cast("string"), "$,", "").try_cast("double")
    out = df.withColumn("price", clean)
    if "quantity" in df.columns:
        out = out.withColumn("line_total", F.col("quantity").cast("string").try_cast("double") * F.col("price"))
    if "sale_time" in df.columns:
        out = out.withColumn("sale_time", standardize("sale_time"))
    return out


def _aliases(df: DataFrame, names: dict[str, str]) -> DataFrame:
    new = {new: F.col(old) for old, new in names.items() if old in df.columns and new not in df.columns}
    return df.withColumns(new) if new else df


def api_sales(df: DataFrame) -> DataFrame:
    return _aliases(df, {"id": "transaction_id", "amount": "total_amount", "created_at": "sale_time"})


def csv_upload(df: DataFrame) -> DataFrame:
    """No byte-order marks, blank text becomes null, on all text columns."""
    new = {}
    for name, kind in df.dtypes:
        if kind == "string":
            s = F.replace(name, F.lit("\ufeff"), F.lit(""))
            new[name] = F.when(F.trim(s) != "", s)
    return df.withColumns(new)


def inventory(df: DataFrame) -> DataFrame:
    current = F.col("current_stock").cast("string").try_cast("double")
    least = F.col("min_stock").cast("string").try_cast("double")
    known = current.isNotNull() & least.isNotNull()
    return df.withColumns(
        {
            "stock_status": F.when(known, F.when(current <= least, "low").otherwise("normal")),
            "stock_ratio": F.when(known, F.when(least > 0, current / least).otherwise(0.0)),
        }
    )


def standardize_names(df: DataFrame) -> DataFrame:
    return _aliases(
        df, {"id": "record_id", "timestamp": "event_timestamp", "created": "created_at", "modified": "updated_at"}
    )


SOURCES = {"pos": pos, "api_sales": api_sales, "csv_upload": csv_upload, "inventory": inventory}

DEFAULT_RULES = {
    "pos": [
        Rule("sale_time", "event_timestamp", "format",
             {"format_type": "date", "input_format": "%Y-%m-%d %H:%M:%S", "format": "%Y-%m-%dT%H:%M:%SZ"}),
        Rule("price", "price", "cast", {"type": "decimal"}),
        Rule("quantity", "quantity", "cast", {"type": "int"}),
    ],
}


def transform(df: DataFrame, source: str, rules: list[Rule] | None = None) -> DataFrame:
    """Rules of the source (given rules replace the defaults), source specifics,
    standard names and metadata."""
    out = apply_rules(df, DEFAULT_RULES.get(source, []) if rules is None else rules)
    out = SOURCES.get(source, lambda d: d)(out)
    return add_metadata(standardize_names(out), source)


def batch_report(df: DataFrame, failed: Column) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_records"),
        F.count_if(~failed).alias("successful"),
        F.count_if(failed).alias("failed"),
    )


def changes_summary(changes: Column, action: Column) -> Column:
    """``field: 'old' → 'new'`` for updates, from JSON ``{field: {old, new}}``."""
    parsed = F.from_json(changes, "map<string, struct<old: string, new: string>>")
    lines = F.transform(
        F.map_entries(parsed),
        lambda e: F.concat(e.key, F.lit(": '"), F.coalesce(e.value.old, F.lit("None")), F.lit("' → '"),
                           F.coalesce(e.value["new"], F.lit("None")), F.lit("'")),
    )
    return F.when(action == "UPDATE", F.array_join(lines, "; ")).otherwise("")


# Words that mark a field as secret.
SECRET_WORDS = ("password", "token", "secret", "key", "authorization")


def _secret(name: str | Column) -> bool | Column:
    if isinstance(name, str):
        return any(w in name.lower() for w in SECRET_WORDS)
    return any_of([F.lower(name).contains(w) for w in SECRET_WORDS])


def sanitize_headers(m: Column, longest: int = 200) -> Column:
    """Header values as short text, those of secret names hidden."""
    return F.transform_values(m, lambda k, v: F.when(_secret(k), F.lit("[REDACTED]")).otherwise(F.left(v.cast("string"), F.lit(longest))))


def sanitize(c: Column, kind: T.DataType, longest: int = 500, most: int = 10) -> Column:
    """A value of any nesting with secret fields hidden, text cut to ``longest``
    characters and lists to ``most`` items, at every depth."""
    if isinstance(kind, T.StringType):
        return F.left(c, F.lit(longest))
    if isinstance(kind, T.StructType):
        inner = [(F.lit("[REDACTED]") if _secret(f.name) else sanitize(c.getField(f.name), f.dataType, longest, most)).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*inner))
    if isinstance(kind, T.ArrayType):
        return F.transform(F.slice(c, 1, most), lambda x: sanitize(x, kind.elementType, longest, most))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(c, lambda k, v: F.when(_secret(k), F.lit("[REDACTED]")).otherwise(F.left(v, F.lit(longest))))
        # values of another type cannot hold the mark, so secret ones become null
        return F.transform_values(c, lambda k, v: F.when(~_secret(k), sanitize(v, kind.valueType, longest, most)))
    return c


def stable_suffix(*parts: Column, digits: int = 10) -> Column:
    """Numeric suffix from a row hash, the same on every run."""
    h = F.conv(F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(12)), 16, 10).cast("long")
    return F.lpad((h % 10**digits).cast("string"), digits, "0")


def customer_id(given: Column, phone: Column, *row: Column) -> Column:
    made = F.concat(F.lit("CUST_"), F.coalesce(F.right(phone, F.lit(4)), F.lit("")), stable_suffix(*row))
    return F.coalesce(F.when(given != "", given), made)


def sale_id(given: Column, branch: Column, day: Column, *row: Column) -> Column:
    head = F.coalesce(F.upper(F.left(branch, F.lit(3))), F.lit("GEN"))
    made = F.concat_ws("_", head, F.date_format(day, "yyyyMMdd"), stable_suffix(*row, digits=5))
    return F.coalesce(F.when(given != "", given), made)


def inventory_id(given: Column, branch: Column, category: Column, *row: Column) -> Column:
    head = F.coalesce(F.upper(F.left(branch, F.lit(3))), F.lit("GEN"))
    cat = F.coalesce(F.upper(F.left(category, F.lit(3))), F.lit("ITM"))
    return F.coalesce(F.when(given != "", given), F.concat_ws("_", head, cat, stable_suffix(*row)))
