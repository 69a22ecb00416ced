"""Catalogue: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.columns import dbl, text
from tillwise.operators import access, joins, marts
from tillwise.plans.marts import RULES_SQL, rules_of
from tillwise.plans.registry import query
from tillwise.plans.standins import recode


@query(
    "join_fk_lookup",
    """
SELECT sale_id, n_name AS branch_name, c_name AS customer_name, CAST(amount AS DOUBLE) AS amount
FROM sales LEFT JOIN nation ON branch_id = n_nationkey LEFT JOIN customer ON customer_id = c_custkey""",
)
def _(t):
    s = joins.lookup(t.sales, t.nation, "branch_id", "n_nationkey", {"branch_name": "n_name"})
    s = joins.lookup(s, t.customer, "customer_id", "c_custkey", {"customer_name": "c_name"})
    return s.select("sale_id", "branch_name", "customer_name", dbl("amount").alias("amount"))


@query(
    "join_surrogate_keys",
    """
WITH p AS (SELECT product_id, 'P' || CAST(product_id AS VARCHAR) AS product_key FROM stock WHERE is_active),
s AS (SELECT s_suppkey, 'S' || CAST(s_suppkey AS VARCHAR) AS staff_key FROM supplier WHERE s_acctbal > 0)
SELECT sale_id, line_number, CAST(strftime(ship_date, '%Y%m%d') AS INTEGER) AS date_key, product_key, staff_key, product_key IS NULL AS quarantined, count(*) AS n
FROM sale_items i LEFT JOIN p ON i.product_id = p.product_id LEFT JOIN s ON staff_id = s_suppkey GROUP BY ALL""",
)
def _(t):
    products = t.stock.where("is_active").withColumn("sk", F.concat(F.lit("P"), text("product_id")))
    staff = t.supplier.where("s_acctbal > 0").withColumn("sk", F.concat(F.lit("S"), text("s_suppkey")))
    facts = t.sale_items.withColumn("date_key", F.date_format("ship_date", "yyyyMMdd").cast("int"))
    both = joins.resolve_keys(
        facts,
        [
            {"table": products, "natural": "product_id", "fact_key": "product_id", "surrogate": "sk", "as": "product_key"},
            {"table": staff, "natural": "s_suppkey", "fact_key": "staff_id", "surrogate": "sk", "as": "staff_key", "required": False},
        ],
    )
    return both.groupBy("sale_id", "line_number", "date_key", "product_key", "staff_key", "quarantined").agg(F.count("*").alias("n"))


@query(
    "join_self_staff_hours",
    """
WITH s AS (SELECT staff_id, ship_date, sum(line_total) AS total FROM sale_items WHERE return_flag <> 'R' GROUP BY 1, 2),
h AS (SELECT staff_id, ship_date, sum(qty) AS hours FROM sale_items WHERE return_flag = 'R' GROUP BY 1, 2)
SELECT s.staff_id, CAST(s.ship_date AS VARCHAR) AS ship_date, CAST(total AS DOUBLE) AS total, CAST(coalesce(hours, 8) AS BIGINT) AS hours FROM s LEFT JOIN h USING (staff_id, ship_date)""",
)
def _(t):
    sold = t.sale_items.where("return_flag <> 'R'").groupBy("staff_id", "ship_date").agg(F.sum("line_total").alias("total"))
    hours = t.sale_items.where("return_flag = 'R'").groupBy("staff_id", "ship_date").agg(F.sum("qty").alias("hours"))
    return sold.join(hours, ["staff_id", "ship_date"], "left").select(
        "staff_id", text("ship_date").alias("ship_date"), dbl("total").alias("total"), F.coalesce("hours", F.lit(8)).cast("long").alias("hours")
    )


@query(
    "join_reverse_counts",
    """
WITH c AS (SELECT branch_id, count(*) AS customers FROM clients GROUP BY 1), i AS (SELECT branch_id, count(*) AS items FROM stock GROUP BY 1),
s AS (SELECT branch_id, count(*) AS recent_sales, CAST(sum(amount) AS DOUBLE) AS recent_revenue FROM sales WHERE sale_date >= (SELECT max(sale_date) FROM sales) - 30 GROUP BY 1),
h AS (SELECT s_nationkey AS branch_id, count(DISTINCT s_suppkey) AS staff FROM supplier GROUP BY 1)
SELECT n_nationkey AS branch_id, coalesce(customers, 0) AS customers, coalesce(items, 0) AS items, coalesce(recent_sales, 0) AS recent_sales,
  coalesce(recent_revenue, 0) AS recent_revenue, coalesce(staff, 0) AS staff
FROM nation LEFT JOIN c ON c.branch_id = n_nationkey LEFT JOIN i ON i.branch_id = n_nationkey LEFT JOIN s ON s.branch_id = n_nationkey LEFT JOIN h ON h.branch_id = n_nationkey""",
)
def _(t):
    recent = t.sales.where(F.col("sale_date") >= F.date_sub(t.last_sale_day, 30))
    one = F.count("*")
    return joins.counts_by_parent(
        t.nation.select(F.col("n_nationkey").alias("branch_id")),
        "branch_id",
        {
            "customers": (t.clients, [one.alias("customers")]),
            "items": (t.stock, [one.alias("items")]),
            "sales": (recent, [one.alias("recent_sales"), dbl(F.sum("amount")).alias("recent_revenue")]),
            "staff": (t.supplier.withColumnRenamed("s_nationkey", "branch_id"), [F.count_distinct("s_suppkey").alias("staff")]),
        },
    )


@query(
    "join_anti_existing",
    "SELECT event_id FROM raw_events WHERE business_key IS NULL OR business_key NOT IN (SELECT 'A' || CAST(sale_id AS VARCHAR) FROM sales WHERE NOT is_active)",
)
def _(t):
    seen = t.sales.where(~F.col("is_active")).select(F.concat(F.lit("A"), text("sale_id")).alias("business_key"))
    return joins.new_only(t.raw_events, seen, ["business_key"]).select("event_id")


@query(
    "join_anti_orphans",
    """
WITH o AS (SELECT count(l_partkey) AS checked, count(*) FILTER (l_partkey NOT IN (SELECT product_id FROM stock WHERE is_active)) AS orphans FROM lineitem)
SELECT checked, orphans, CAST(orphans AS DOUBLE) * 100 / checked AS orphan_rate, CAST(orphans AS DOUBLE) * 100 / checked <= 5.0 AS passed FROM o""",
)
def _(t):
    return joins.orphan_rate(t.lineitem, "l_partkey", t.stock.where("is_active"), "product_id", 0.05)


@query(
    "join_semi_enabled",
    f"WITH {RULES_SQL} SELECT DISTINCT l_partkey AS rule_id FROM lineitem WHERE l_returnflag = 'A' AND l_partkey IN (SELECT rule_id FROM rules WHERE enabled)",
)
def _(t):
    asked = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("rule_id")).distinct()
    return asked.join(rules_of(t).where("enabled"), "rule_id", "left_semi")


@query(
    "join_item_iexact",
    """
WITH a AS (SELECT upper(category) AS item, branch_id, count(*) AS sold FROM sale_items JOIN stock USING (product_id) GROUP BY 1, 2),
b AS (SELECT lower(category) AS name, branch_id, sum(stock_quantity) AS stock FROM stock GROUP BY 1, 2)
SELECT item, a.branch_id, sold, CAST(stock AS BIGINT) AS stock FROM a JOIN b ON lower(item) = lower(name) AND a.branch_id = b.branch_id""",
)
def _(t):
    sold = t.sale_items.join(t.stock, "product_id").groupBy(F.upper("category").alias("item"), "branch_id").agg(F.count("*").alias("sold"))
    held = t.stock.groupBy(F.lower("category").alias("name"), "branch_id").agg(F.sum("stock_quantity").alias("stock"))
    return joins.case_insensitive(sold, held, "item", "name", ["branch_id"]).drop("name")


# One data location per document source and language, one policy per category.
MAPS_SQL = """maps AS (SELECT source || '.' || lang AS location, lang AS category, count(*) AS record_count FROM documents GROUP BY 1, 2),
policies AS (SELECT DISTINCT lang AS category, CASE lang WHEN 'en' THEN 'DELETE' WHEN 'fr' THEN 'ANONYMIZE' ELSE 'ARCHIVE' END AS policy_action,
  CASE lang WHEN 'en' THEN 365 WHEN 'fr' THEN 730 ELSE 90 END AS retention_days, lang <> 'de' AS is_active FROM documents)"""


def data_maps(t):
    return t.documents.groupBy(F.concat_ws(".", "source", "lang").alias("location"), F.col("lang").alias("category")).agg(F.count("*").alias("record_count"))


def policies(t):
    lang = F.col("lang")
    return t.documents.select(
        lang.alias("category"),
        F.when(lang == "en", "DELETE").when(lang == "fr", "ANONYMIZE").otherwise("ARCHIVE").alias("policy_action"),
        F.when(lang == "en", 365).when(lang == "fr", 730).otherwise(90).alias("retention_days"),
        (lang != "de").alias("is_active"),
    ).distinct()


@query(
    "join_policy_category",
    f"WITH {MAPS_SQL} SELECT location, policy_action, retention_days, record_count FROM maps JOIN policies USING (category) WHERE is_active",
)
def _(t):
    return data_maps(t).join(policies(t).where("is_active"), "category").select("location", "policy_action", "retention_days", "record_count")


@query(
    "join_subject_array_contains",
    """
WITH m AS (SELECT doc_id AS location, [doc_id % 1500, (doc_id * 7) % 1500, doc_id % 11] AS subject_ids FROM documents),
e AS (SELECT DISTINCT location, s AS subject_id FROM (SELECT location, unnest(subject_ids) AS s FROM m))
SELECT subject_id, location FROM e JOIN customer ON c_custkey = subject_id WHERE c_acctbal < 0""",
)
def _(t):
    d = F.col("doc_id")
    maps = t.documents.select(d.alias("location"), F.array(d % 1500, d * 7 % 1500, d % 11).alias("subject_ids"))
    subjects = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("subject_id"))
    return joins.subject_rows(maps, subjects).select("subject_id", "location")


ROLE_SQL = "CASE user_id % 7 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(access.ROLES)) + " END"
RESOURCES = {"error": "audit_logs", "view": "dashboards", "click": "reports", "purchase": "users", "signup": "dq_rules"}
ACTIONS = {"0": "read", "1": "create", "2": "update", "3": "delete", "4": "export"}


def requests(t):
    role = recode(text(F.col("user_id") % 7), {str(i): r for i, r in enumerate(access.ROLES)})
    return t.events.select(
        "event_id",
        role.alias("role"),
        recode("event_type", RESOURCES).alias("resource"),
        recode(text(F.col("event_id") % 5), ACTIONS).alias("action"),
    )


MATRIX_SQL = "matrix(role, resource, action) AS (VALUES " + ", ".join(str(x) for x in access.matrix()) + ")"
REQUEST_SQL = (
    f"requests AS (SELECT event_id, {ROLE_SQL} AS role, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RESOURCES.items())
    + " END AS resource, CASE event_id % 5 "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ACTIONS.items())
    + " END AS action FROM events)"
)


@query(
    "join_role_permission",
    f"""WITH {MATRIX_SQL}, {REQUEST_SQL}
SELECT event_id, r.role, r.resource, r.action, m.role IS NOT NULL AS allowed FROM requests r LEFT JOIN matrix m ON r.role = m.role AND r.resource = m.resource AND r.action = m.action""",
)
def _(t):
    return access.permitted(requests(t))


@query(
    "join_range_consent",
    """
WITH c AS (SELECT event_id AS consent_id, user_id AS subject_id, ts AS given, least(ts + to_seconds(CAST(value * 6000 AS BIGINT)), (SELECT max(ts) FROM events) + INTERVAL 1 SECOND) AS until FROM events WHERE event_type IN ('signup', 'view'))
SELECT p.event_id, p.user_id AS subject_id, consent_id FROM events p JOIN c ON c.subject_id = p.user_id AND given <= p.ts AND p.ts < until WHERE p.event_type = 'purchase'""",
)
def _(t):
    # consents of a subject overlap: every one that covers a use is named
    horizon = marts.max_of(t.events, "ts") + F.expr("INTERVAL 1 SECOND")
    seconds = F.round(F.col("value") * 6000).cast("long")
    consents = t.events.where(F.col("event_type").isin("signup", "view")).select(
        F.col("event_id").alias("consent_id"),
        F.col("user_id").alias("subject_id"),
        F.col("ts").alias("given"),
        F.least(F.timestamp_micros(F.unix_micros("ts") + seconds * 1000000), horizon).alias("until"),
    )
    used = t.events.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("subject_id"), "ts")
    return joins.covering(used, consents, ["subject_id"], "ts", "given", "until").select("event_id", "subject_id", "consent_id")


@query(
    "join_asof_checkpoint",
    """
WITH v AS (SELECT user_id AS key_id, event_id AS version, ts AS created FROM events WHERE event_type = 'signup'),
u AS (SELECT event_id, user_id AS key_id, ts FROM events WHERE event_type = 'click')
SELECT u.event_id, u.key_id, v.version FROM u ASOF JOIN v ON u.key_id = v.key_id AND u.ts >= v.created""",
)
def _(t):
    versions = t.events.where("event_type = 'signup'").select(F.col("user_id").alias("key_id"), F.col("event_id").alias("version"), F.col("ts").alias("created"))
    used = t.events.where("event_type = 'click'").select("event_id", F.col("user_id").alias("key_id"), "ts")
    horizon = marts.max_of(t.events, "ts") + F.expr("INTERVAL 1 SECOND")
    out = joins.as_of_versions(used, versions, "key_id", "ts", "created", "version", horizon)
    return out.select("event_id", "key_id", "version")
