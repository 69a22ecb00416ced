"""Catalogue: ingest operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions import checks
from tillwise.functions.columns import dbl, text
from tillwise.operators import ingest, marts
from tillwise.plans.registry import query
from tillwise.plans.validation import POS_SQL, pos_records
from tillwise.session import scratch_path

RAW_SQL = """keyed AS (SELECT *, CASE WHEN source IN ('pos', 'api_sales') AND trim(business_key) <> '' THEN source || '_order_id_' || business_key
  WHEN source = 'staff' AND trim(business_key) <> '' THEN source || '_employee_id_' || business_key ELSE source || '_b1_' || CAST(event_id AS VARCHAR) END AS ingest_id FROM raw_events)"""


def keyed(t):
    raw = t.raw_events.withColumns({"order_id": F.col("business_key"), "employee_id": F.col("business_key")})
    return raw.withColumn("ingest_id", ingest.ingest_id(F.col("source"), raw.columns, F.lit("b1"), F.col("event_id")))


@query("ingest_id", f"WITH {RAW_SQL} SELECT event_id, ingest_id FROM keyed")
def _(t):
    return keyed(t).select("event_id", "ingest_id")


@query(
    "ingest_dedup",
    f"""
WITH {RAW_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ingest_id ORDER BY event_id) AS rn FROM keyed)
SELECT ingest_id, event_id, CAST(amount AS DOUBLE) AS amount FROM r WHERE rn = 1 AND ingest_id NOT IN (SELECT ingest_id FROM keyed WHERE state = 'error')""",
)
def _(t):
    stored = keyed(t).where("state = 'error'").select("ingest_id").distinct()
    return ingest.deduplicate(keyed(t), ["event_id"], stored).select("ingest_id", "event_id", dbl("amount").alias("amount"))


@query(
    "ingest_batches",
    """
WITH r AS (SELECT event_id, (row_number() OVER (ORDER BY created_at, event_id) - 1) // 1000 AS b FROM raw_events)
SELECT event_id, CAST(b AS BIGINT) AS batch_no, 'job_run_' || CAST(b AS VARCHAR) AS batch_id FROM r""",
)
def _(t):
    out = ingest.batches(t.raw_events, ["created_at", "event_id"])
    return out.select("event_id", "batch_no", "batch_id")


@query(
    "ingest_validate_split",
    f"WITH {POS_SQL} SELECT k, n, CASE WHEN len(e) = 0 THEN 'valid' ELSE 'invalid' END AS state, len(e) AS error_count, array_to_string(e, ',') AS error_list FROM errs",
)
def _(t):
    checked = checks.validate(pos_records(t), "pos")
    return checked.select(
        "k", "n", ingest.state(F.col("is_valid")).alias("state"), F.size("error_keys").cast("long").alias("error_count"), F.array_join("error_keys", ",").alias("error_list")
    )


@query(
    "ingest_enrich",
    """
SELECT event_id, source AS source, CAST(amount * 2 AS DOUBLE) AS amount, CAST(qty AS VARCHAR) AS qty, 'b' || CAST(user_id % 25 AS VARCHAR) AS branch FROM raw_events""",
)
def _(t):
    payload = F.create_map(F.lit("source"), "source", F.lit("amount"), text("amount"), F.lit("qty"), text("qty"))
    added = F.create_map(F.lit("amount"), text(F.col("amount") * 2), F.lit("branch"), F.concat(F.lit("b"), text(F.col("user_id") % 25)))
    m = t.raw_events.select("event_id", ingest.enrich(payload, added).alias("m"))
    return m.select("event_id", *[F.col("m")[c].alias(c) for c in ("source", "qty", "branch")], F.col("m")["amount"].cast("double").alias("amount"))


@query(
    "ingest_aggregate_by_source",
    """
SELECT CASE WHEN source IN ('pos', 'api_sales') THEN 'sales' WHEN source = 'inventory' THEN 'inventory' ELSE 'staff' END AS family, count(*) AS events,
  CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(qty) AS BIGINT) AS qty FROM raw_events WHERE state = 'pending' AND source IN ('pos', 'api_sales', 'inventory', 'staff') GROUP BY 1""",
)
def _(t):
    families = {"sales": ["pos", "api_sales"], "inventory": ["inventory"], "staff": ["staff"]}
    return ingest.by_source(
        t.raw_events.where("state = 'pending'"), families,
        [F.count("*").alias("events"), dbl(F.sum("amount")).alias("amount"), F.sum("qty").alias("qty")],
    )


@query(
    "ingest_error_rate_alert",
    """
WITH g AS (SELECT source, CAST(CAST(created_at AS DATE) AS VARCHAR) AS batch, count(*) AS total, count(*) FILTER (state = 'error') AS errors FROM raw_events GROUP BY ALL)
SELECT *, CAST(errors AS DOUBLE) * 100 / total AS error_rate, 'high' AS severity FROM g WHERE CAST(errors AS DOUBLE) * 100 / total > 10""",
)
def _(t):
    return ingest.error_rate_alerts(t.raw_events.withColumn("batch", text(F.to_date("created_at"))), ["source", "batch"])


@query(
    "ingest_run_metrics",
    """
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS run, count(*) AS rows_processed, count(*) FILTER (state = 'error') AS rows_failed,
  CAST(floor(epoch(max(created_at))) - floor(epoch(min(created_at))) AS BIGINT) AS duration_seconds,
  CAST(count(*) - count(*) FILTER (state = 'error') AS DOUBLE) * 100 / count(*) AS success_rate FROM raw_events GROUP BY 1""",
)
def _(t):
    return ingest.run_metrics(t.raw_events, text(F.to_date("created_at")))


@query(
    "ingest_lineage_log",
    f"""
WITH {RAW_SQL}, r AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY ingest_id ORDER BY event_id) = 1)
SELECT 'INGEST' AS event_type, 'source' AS source_table, 'raw_events' AS target_table, count(*) AS affected_rows FROM r
UNION ALL SELECT 'VALIDATE', 'raw_events', 'raw_errors', count(*) FROM r WHERE state = 'error'
UNION ALL SELECT 'AGGREGATE', 'raw_events', 'daily', count(*) FROM (SELECT DISTINCT source, CAST(created_at AS DATE) FROM r WHERE state <> 'error')""",
)
def _(t):
    run = ingest.Lineage()
    fresh = run.stage(ingest.deduplicate(keyed(t), ["event_id"]), "INGEST", "source", "raw_events")
    checked = run.stage(fresh, "VALIDATE", "raw_events", "raw_errors", F.col("state") == "error")
    daily = checked.where("state <> 'error'").groupBy("source", F.to_date("created_at").alias("day")).agg(F.sum("amount").alias("total"), F.count("*").alias("n"))
    run.stage(daily, "AGGREGATE", "raw_events", "daily").write.parquet(scratch_path(t.spark, "daily"))
    return run.rows(t.spark)


# Kind, rows as (ts, state) and days: the generated events span 30 days, so most limits are shorter here.
RETAINED = [
    ("raw_events", "SELECT created_at AS ts, state FROM raw_events", 20),
    ("errors", "SELECT ts, CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS state FROM events WHERE event_type = 'error'", 15),
    ("runs", "SELECT finished_at AS ts, CASE WHEN rows_scanned % 2 = 0 THEN 'archived' ELSE 'done' END AS state FROM dq_runs", 12),
    ("alerts", "SELECT ts, CASE WHEN event_id % 5 = 0 THEN 'resolved' END AS state FROM events WHERE event_type <> 'view'", 7),
    ("warehouse_raw", "SELECT ts, 'any' AS state FROM events", 25),
    ("dq", "SELECT finished_at AS ts, CAST(NULL AS VARCHAR) AS state FROM dq_runs", 10),
]


@query(
    "retention_cleanup",
    "WITH m AS (SELECT max(ts) AS m FROM events), r AS ("
    + " UNION ALL ".join(
        f"SELECT '{kind}' AS item, coalesce(ts < m - INTERVAL {days} DAYS{f" AND state = '{state}'" if state else ''}, false) AS old FROM ({sql}), m"
        for (kind, sql, days), state in zip(RETAINED, [s for _, s in ingest.RETENTION.values()], strict=True)
    )
    + ") SELECT item, count(*) FILTER (old) AS dropped, count(*) FILTER (NOT old) AS kept FROM r GROUP BY item",
)
def _(t):
    as_of = marts.max_of(t.events, "ts")
    turn = lambda column, by, value, other=None: F.when(F.col(column) % by == 0, value).otherwise(F.lit(other))
    tables = {
        "raw_events": t.raw_events.select(F.col("created_at").alias("ts"), "state"),
        "errors": t.events.where("event_type = 'error'").select("ts", turn("event_id", 3, "resolved", "open").alias("state")),
        "runs": t.dq_runs.select(F.col("finished_at").alias("ts"), turn("rows_scanned", 2, "archived", "done").alias("state")),
        "alerts": t.events.where("event_type <> 'view'").select("ts", turn("event_id", 5, "resolved").alias("state")),
        "warehouse_raw": t.events.select("ts", F.lit("any").alias("state")),
        "dq": t.dq_runs.select(F.col("finished_at").alias("ts"), F.lit(None).cast("string").alias("state")),
    }
    parts = []
    for kind, _, days in RETAINED:
        kept, counts = ingest.retention(tables[kind], ingest.expired(kind, "ts", "state", as_of, days=days))
        path = scratch_path(t.spark, f"kept-{kind}")
        kept.write.parquet(path)
        left = t.spark.read.parquet(path).agg(F.count("*").alias("kept")).select(F.lit(kind).alias("item"), "kept")
        parts.append(counts.select(F.lit(kind).alias("item"), "dropped").join(left, "item"))
    return reduce(DataFrame.unionByName, parts)
