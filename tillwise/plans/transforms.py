"""Catalogue: scalar transforms and the rule fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions import times
from tillwise.functions import transforms as tr
from tillwise.functions.columns import text
from tillwise.functions.transforms import Rule, apply_rules
from tillwise.plans.registry import query

# A loose text record per sale line: everything is a string, some of it dirty.
LOOSE_SQL = """loose AS (SELECT l_orderkey AS k, l_linenumber AS n, '  Item ' || CAST(l_partkey AS VARCHAR) || '   of ' || l_returnflag || '-' || l_linestatus || '  ' AS label,
  CASE WHEN l_partkey % 11 = 0 THEN 'n/a' WHEN l_partkey % 13 = 0 THEN '' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
  CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, CASE WHEN l_linenumber % 2 = 0 THEN 'Yes' ELSE 'no' END AS flag,
  CASE WHEN l_linenumber = 3 THEN strftime(l_shipdate, '%m/%d/%Y') WHEN l_linenumber = 4 THEN 'soon' ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS tm FROM lineitem)"""


def loose(t):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    return t.lineitem.select(
        F.col("l_orderkey").alias("k"),
        n.alias("n"),
        F.concat(F.lit("  Item "), text("l_partkey"), F.lit("   of "), "l_returnflag", F.lit("-"), "l_linestatus", F.lit("  ")).alias("label"),
        F.when(p % 11 == 0, "n/a").when(p % 13 == 0, "").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("price"),
        text(F.col("l_quantity").cast("long")).alias("quantity"),
        F.when(n % 2 == 0, "Yes").otherwise("no").alias("flag"),
        F.when(n == 3, F.date_format("l_shipdate", "MM/dd/yyyy")).when(n == 4, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("tm"),
    )


def one_rule(name: str, sql_expr: str, rule: Rule):
    """Register one transform over the loose records next to its SQL form."""

    @query(name, f"WITH {LOOSE_SQL} SELECT k, n, {sql_expr} AS result FROM loose")
    def _(t):
        return apply_rules(loose(t), [rule]).select("k", "n", "result")


P = "TRY_CAST(trim(price) AS DOUBLE)"
one_rule("xf_format_number", f"CASE WHEN {P} IS NULL THEN price ELSE printf('%.2f', CAST({P} AS DOUBLE)) END", Rule("price", "result", "format", {"format_type": "number", "decimals": 2}))
# Centred in stars, cut and set right, and as it is, between braces.
CENTRED = "CASE WHEN length(label) >= 30 THEN label ELSE repeat('*', (30 - length(label)) // 2) || label || repeat('*', 30 - length(label) - (30 - length(label)) // 2) END"
one_rule("xf_format_string", f"'[' || {CENTRED} || '|' || lpad(left(label, 6), 8, ' ') || '|' || rpad(left(label, 3), 5, '0') || '] {{' || label || '}}'",
         Rule("label", "result", "format", {"format_type": "string", "format": "[{0:*^30}|{0:>8.6}|{0:05.3}] {{{0}}}"}))
one_rule("xf_extract_regex", "CASE WHEN regexp_matches(label, 'of ([A-Z])-O') THEN regexp_extract(label, 'of ([A-Z])-O', 1) ELSE 'none' END",
         Rule("label", "result", "extract", {"regex": "of ([A-Z])-O", "group": 1, "default": "none"}))
one_rule("xf_extract_substr", "substring(label, greatest(length(label) - 5, 0) + 1, 3)", Rule("label", "result", "extract", {"start": -5, "end": -2}))
one_rule("xf_replace", "regexp_replace(replace(label, 'Item', 'SKU'), '[0-9]+', '#', 'g')",
         Rule("label", "result", "replace", {"replacements": [{"pattern": "Item", "replace_with": "SKU"}, {"pattern": "[0-9]+", "replace_with": "#", "regex": True}]}))
one_rule("xf_calc_multiply", f"coalesce({P}, 0) * 1.5::DOUBLE", Rule("price", "result", "calculate", {"operation": "multiply", "multiplier": 1.5}))
one_rule("xf_calc_divide", f"coalesce({P}, 0) / 4::DOUBLE", Rule("price", "result", "calculate", {"operation": "divide", "divisor": 4}))
one_rule("xf_calc_add", f"coalesce({P}, 0) + 2.5::DOUBLE", Rule("price", "result", "calculate", {"operation": "add", "addend": 2.5}))
one_rule("xf_calc_subtract", f"coalesce({P}, 0) - 2.5::DOUBLE", Rule("price", "result", "calculate", {"operation": "subtract", "subtrahend": 2.5}))
one_rule("xf_calc_percentage", f"CASE WHEN coalesce({P}, 0) <> 0 THEN CAST(quantity AS DOUBLE) / coalesce({P}, 0) * 100 ELSE 0.0 END",
         Rule("quantity", "result", "calculate", {"operation": "percentage", "total_field": "price"}))
one_rule("xf_calc_formula", f"coalesce(CASE WHEN {P} <> 0 THEN (CAST(quantity AS DOUBLE) * 2 + 1) / {P} END, CAST(quantity AS DOUBLE))",
         Rule("quantity", "result", "calculate", {"operation": "formula", "formula": "(value * 2 + 1) / price"}))
one_rule("xf_lookup", "CASE flag WHEN 'Yes' THEN 'open' ELSE 'closed' END", Rule("flag", "result", "lookup", {"table": {"Yes": "open"}, "default": "closed"}))
one_rule("xf_concat", "flag || '|' || price || '|' || quantity", Rule("flag", "result", "concatenate", {"fields": ["price", "quantity"], "separator": "|"}))
one_rule("xf_split", "trim(split_part(label, 'of', 2))", Rule("label", "result", "split", {"separator": "of", "index": 1}))
one_rule("xf_hash", "sha256(label)", Rule("label", "result", "encrypt", {"algorithm": "sha256"}))
one_rule("xf_mask_full", "repeat('*', length(price))", Rule("price", "result", "mask", {"type": "full"}))
one_rule("xf_mask_partial", "CASE WHEN length(price) <= 4 THEN repeat('*', length(price)) ELSE left(price, 2) || repeat('*', length(price) - 4) || right(price, 2) END",
         Rule("price", "result", "mask", {"type": "partial"}))
one_rule("xf_condition", "CASE WHEN n > 3 THEN upper(flag) ELSE NULL END", Rule("flag", "result", "normalize", {"case": "upper"}, condition="n > 3"))
one_rule("xf_timestamp", """CASE WHEN TRY_CAST(tm AS TIMESTAMP) IS NOT NULL THEN strftime(TRY_CAST(tm AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S')
  WHEN try_strptime(tm, '%m/%d/%Y') IS NOT NULL THEN strftime(try_strptime(tm, '%m/%d/%Y'), '%Y-%m-%dT%H:%M:%S') ELSE tm END""", Rule("tm", "result", "custom", {"function": "standard_time"}))
one_rule("xf_custom", "reverse(flag)", Rule("flag", "result", "custom", {"function": "reverse_text"}))
tr.register("standard_time", lambda v, params: times.standardize(v))
tr.register("reverse_text", lambda v, params: F.reverse(v))


@query(
    "xf_cast",
    f"""WITH {LOOSE_SQL} SELECT k, n, CAST(trunc({P}) AS BIGINT) AS as_int, {P} AS as_float, CAST(CAST(TRY_CAST(trim(price) AS DECIMAL(38,10)) AS DECIMAL(18,2)) AS DOUBLE) AS as_decimal,
  lower(flag) IN ('true', '1', 'yes', 'y', 'on') AS as_bool, CAST(TRY_CAST(CASE WHEN regexp_matches(tm, '^[0-9]{{4}}-') THEN tm END AS TIMESTAMP) AS VARCHAR) AS as_time FROM loose""",
)
def _(t):
    out = apply_rules(
        loose(t),
        [
            Rule("price", "as_int", "cast", {"type": "int"}),
            Rule("price", "as_float", "cast", {"type": "float"}),
            Rule("price", "as_decimal", "cast", {"type": "decimal"}),
            Rule("flag", "as_bool", "cast", {"type": "bool"}),
            Rule("tm", "as_time", "cast", {"type": "datetime"}),
        ],
    )
    return out.select("k", "n", "as_int", "as_float", F.col("as_decimal").cast("double").alias("as_decimal"), "as_bool", text("as_time").alias("as_time"))


@query(
    "xf_format_date",
    f"""WITH {LOOSE_SQL} SELECT k, n, coalesce(strftime(try_strptime(tm, '%Y-%m-%d %H:%M:%S'), '%d/%m/%Y at %H'), tm) AS result FROM loose""",
)
def _(t):
    rule = Rule("tm", "result", "format", {"format_type": "date", "input_format": "%Y-%m-%d %H:%M:%S", "format": "%d/%m/%Y at %H"})
    return apply_rules(loose(t), [rule]).select("k", "n", "result")


@query(
    "xf_normalize",
    f"""WITH {LOOSE_SQL}, s AS (SELECT k, n, regexp_replace(regexp_replace(label, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS s FROM loose)
SELECT k, n, upper(s) AS up, lower(s) AS low, upper(left(s, 1)) || lower(substring(s, 2)) AS sentence, regexp_replace(s, '[^a-zA-Z0-9 ]', '', 'g') AS plain FROM s""",
)
def _(t):
    return apply_rules(
        loose(t),
        [
            Rule("label", "up", "normalize", {"case": "upper"}),
            Rule("label", "low", "normalize", {"case": "lower"}),
            Rule("label", "sentence", "normalize", {"case": "sentence"}),
            Rule("label", "plain", "normalize", {"remove_special_chars": True}),
        ],
    ).select("k", "n", "up", "low", "sentence", "plain")


@query("xf_mask_email", "SELECT customer_id, left(email, 1) || repeat('*', position('@' IN email) - 2) || substring(email, position('@' IN email)) AS masked FROM clients")
def _(t):
    return apply_rules(t.clients, [Rule("email", "masked", "mask", {"type": "email"})]).select("customer_id", "masked")


@query("xf_metadata", "SELECT event_id, 'pos' AS _source, true AS stamped, true AS hashed FROM events")
def _(t):
    out = tr.add_metadata(t.events, "pos")
    return out.select("event_id", "_source", F.col("_processed_at").isNotNull().alias("stamped"), (F.length("_record_hash") == 64).alias("hashed"))


@query(
    "xf_record_hash",
    "SELECT c_custkey, sha256('{\"c_acctbal\":' || CAST(c_acctbal AS VARCHAR) || ',\"c_custkey\":' || CAST(c_custkey AS VARCHAR) || ',\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || CAST(c_nationkey AS VARCHAR) || '}') AS record_hash FROM customer",
)
def _(t):
    c = t.customer.withColumn("_source", F.lit("x"))
    return c.select("c_custkey", tr.record_hash(c.columns).alias("record_hash"))


@query(
    "xf_source_pos",
    f"""WITH {LOOSE_SQL} SELECT k, n, {P} AS price, CAST(quantity AS DOUBLE) * {P} AS line_total, CASE WHEN n = 3 THEN strftime(try_strptime(tm, '%m/%d/%Y'), '%Y-%m-%dT%H:%M:%S') ELSE replace(tm, ' ', 'T') END AS sale_time FROM loose""",
)
def _(t):
    dirty = loose(t).withColumn("price", F.when(F.col("price").rlike("^[0-9]"), F.concat(F.lit("$"), "price")).otherwise(F.col("price")))
    return tr.pos(dirty.withColumnRenamed("tm", "sale_time")).select("k", "n", "price", "line_total", "sale_time")


@query(
    "xf_source_api_sales",
    "SELECT sale_id AS transaction_id, CAST(amount AS DOUBLE) AS total_amount, CAST(ts AS VARCHAR) AS sale_time FROM sales",
)
def _(t):
    s = t.sales.select(F.col("sale_id").alias("id"), F.col("amount").cast("double").alias("amount"), text("ts").alias("created_at"))
    return tr.api_sales(s).select("transaction_id", "total_amount", "sale_time")


@query("xf_source_csv", f"WITH {LOOSE_SQL} SELECT k, n, CASE WHEN trim(price) <> '' THEN price END AS price, label FROM loose")
def _(t):
    marked = loose(t).withColumn("label", F.concat(F.lit("﻿"), "label"))
    return tr.csv_upload(marked).select("k", "n", "price", "label")


@query(
    "xf_source_inventory",
    """
SELECT product_id, CASE WHEN stock_quantity <= reorder_level THEN 'low' ELSE 'normal' END AS stock_status, CASE WHEN reorder_level > 0 THEN CAST(stock_quantity AS DOUBLE) / reorder_level ELSE 0.0 END AS stock_ratio FROM stock""",
)
def _(t):
    s = t.stock.select("product_id", text("stock_quantity").alias("current_stock"), text("reorder_level").alias("min_stock"))
    return tr.inventory(s).select("product_id", "stock_status", "stock_ratio")


@query("xf_standardize", "SELECT event_id AS record_id, CAST(ts AS VARCHAR) AS event_timestamp, user_id AS created_at FROM events")
def _(t):
    e = t.events.select(F.col("event_id").alias("id"), text("ts").alias("timestamp"), F.col("user_id").alias("created"))
    return tr.standardize_names(e).select("record_id", "event_timestamp", "created_at")


@query(
    "xf_batch_report",
    f"WITH {LOOSE_SQL} SELECT count(*) AS total_records, count({P}) AS successful, count(*) - count({P}) AS failed FROM loose",
)
def _(t):
    return tr.batch_report(tr.pos(loose(t)), F.col("price").isNull())


@query(
    "json_changes_summary",
    """
SELECT event_id, CASE WHEN event_type = 'click' THEN 'k: ''' || CAST(CAST(props->>'$.k' AS BIGINT) AS VARCHAR) || ''' → ''' || CAST(user_id AS VARCHAR) || '''; type: ''None'' → ''' || event_type || '''' ELSE '' END AS summary FROM events""",
)
def _(t):
    changes = F.to_json(
        F.create_map(
            F.lit("k"), F.struct(F.get_json_object("props", "$.k").alias("old"), text("user_id").alias("new")),
            F.lit("type"), F.struct(F.lit(None).cast("string").alias("old"), F.col("event_type").alias("new")),
        )
    )
    action = F.when(F.col("event_type") == "click", "UPDATE").otherwise("CREATE")
    return t.events.select("event_id", tr.changes_summary(changes, action).alias("summary"))


@query(
    "json_sanitize",
    """
SELECT doc_id, left(text, 500) AS body, '[REDACTED]' AS hidden, left(source, 500) AS origin, least(len(string_split(text, ' ')), 10) AS kept, left(string_split(text, ' ')[1], 500) AS first_note,
  '[REDACTED]' AS first_key, left(text, 200) AS agent, '[REDACTED]' AS cookie, n_chars FROM documents""",
)
def _(t):
    words = F.split("text", " ")
    request = F.struct(
        F.col("text").alias("body"),
        F.create_map(F.lit("Api_Token"), "lang", F.lit("origin"), "source").alias("extra"),
        F.transform(words, lambda w: F.struct(w.alias("note"), F.lit(7).alias("secret_key"))).alias("parts"),
        F.col("n_chars").alias("size"),
    )
    headers = F.create_map(F.lit("User-Agent"), "text", F.lit("X-Auth-Token"), "lang")
    df = t.documents.select("doc_id", request.alias("r"), headers.alias("h"))
    s = df.select("doc_id", tr.sanitize(F.col("r"), df.schema["r"].dataType).alias("r"), tr.sanitize_headers(F.col("h")).alias("h"))
    first = F.get("r.parts", F.lit(0))
    return s.select(
        "doc_id",
        "r.body",
        F.col("r.extra")["Api_Token"].alias("hidden"),
        F.col("r.extra")["origin"].alias("origin"),
        F.size("r.parts").cast("bigint").alias("kept"),
        first["note"].alias("first_note"),
        first["secret_key"].alias("first_key"),
        F.col("h")["User-Agent"].alias("agent"),
        F.col("h")["X-Auth-Token"].alias("cookie"),
        F.col("r.size").alias("n_chars"),
    )


@query("location_display", "SELECT n_nationkey, n_name || ', ' || r_name AS location FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws(", ", "n_name", "r_name").alias("location"))


H = "CAST('0x' || left(sha256(CAST(sale_id AS VARCHAR)), 12) AS BIGINT)"


@query(
    "id_generate",
    f"""
SELECT sale_id, CASE WHEN sale_id % 4 = 0 THEN 'S' || CAST(sale_id AS VARCHAR) ELSE left(n_name, 3) || '_' || strftime(sale_date, '%Y%m%d') || '_' || lpad(CAST({H} % 100000 AS VARCHAR), 5, '0') END AS public_id
FROM sales JOIN nation ON branch_id = n_nationkey""",
)
def _(t):
    s = t.sales.join(t.nation, F.col("branch_id") == F.col("n_nationkey"))
    given = F.when(F.col("sale_id") % 4 == 0, F.concat(F.lit("S"), text("sale_id"))).otherwise("")
    return s.select("sale_id", tr.sale_id(given, F.col("n_name"), F.col("sale_date"), text("sale_id")).alias("public_id"))
