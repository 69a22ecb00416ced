"""Catalogue: streaming jobs over the given tables as a file source.

Each job drains the available input and returns what it wrote; the reference
SQL is the batch form on the windows the watermark has closed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.columns import dbl, text
from tillwise.plans.ingestion import RAW_SQL, keyed
from tillwise.plans.registry import query
from tillwise.plans.security import SESSION_SQL
from tillwise.plans.standins import Tables
from tillwise.plans.validation import POS_SQL, pos_records
from tillwise.plans.windows import lockout_sql
from tillwise.session import scratch_path
from tillwise.streaming import jobs


class Streams(Tables):
    """The same tables read as streams."""

    def raw(self, name: str):
        batch = self.spark.read.parquet(self.path(name))
        # a glob, because the file source takes folders and patterns only
        df = jobs.source(self.spark, self.path(name) + "*", batch.schema)
        return df.select(*[F.col(n).cast("timestamp").alias(n) if t == "timestamp_ntz" else F.col(n) for n, t in df.dtypes])


def streams(t) -> Streams:
    return Streams(t.spark, t.folder)


@query(
    "stream_failed_login_burst",
    """
WITH b AS (SELECT user_id, time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '2000-01-01') AS a, count(*) AS c FROM log_entries WHERE action = 'login' AND status >= 400 GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT user_id, c AS count, CAST(a AS VARCHAR) AS first_seen, CAST(a + INTERVAL 5 MINUTES AS VARCHAR) AS last_seen FROM b WHERE a + INTERVAL 5 MINUTES <= (SELECT max(ts) FROM log_entries WHERE TRUE) - INTERVAL 10 MINUTES""",
)
def _(t):
    out = jobs.drain(jobs.failed_login_burst(streams(t).log_entries), "bursts")
    return out.select("user_id", "count", text("first_seen").alias("first_seen"), text("last_seen").alias("last_seen"))


@query(
    "stream_brute_force",
    """
WITH f AS (SELECT ip, ts FROM audit_events WHERE action = 'LOGIN_FAILED' AND NOT success),
w AS (SELECT ip, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01') - to_hours(CAST(u.i AS INTEGER)) AS a FROM f, (SELECT unnest(range(12)) AS i) u), g AS (SELECT ip, a, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT ip, n AS failed_attempts, CAST(a AS VARCHAR) AS window_start, CAST(a + INTERVAL 12 HOURS AS VARCHAR) AS window_end FROM g WHERE a + INTERVAL 12 HOURS <= (SELECT max(ts) FROM f) - INTERVAL 10 MINUTES""",
)
def _(t):
    # sparse events: 12 hours sliding by one hour instead of 15 minutes by one
    out = jobs.drain(jobs.brute_force(streams(t).audit_events, minutes=720, slide=60), "brute")
    return out.select("ip", "failed_attempts", text("window_start").alias("window_start"), text("window_end").alias("window_end"))


@query(
    "stream_rate_sessions",
    f"""WITH {SESSION_SQL.format(gap='12 HOURS', table='events')} SELECT user_id, requests, CAST(started AS VARCHAR) AS started, CAST(ended + INTERVAL 12 HOURS AS VARCHAR) AS closed FROM sessions
WHERE requests > 10 AND ended + INTERVAL 12 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""",
)
def _(t):
    out = jobs.drain(jobs.rate_sessions(streams(t).events.select("user_id", "ts"), "user_id", "12 hours", 10), "sessions")
    return out.select("user_id", "requests", text("started").alias("started"), text("closed").alias("closed"))


@query("stream_ingest_dedup", f"WITH {RAW_SQL} SELECT DISTINCT ingest_id FROM keyed")
def _(t):
    path = scratch_path(t.spark, "deduplicated")
    jobs.dedup(keyed(streams(t)).select("ingest_id", "created_at"), path)
    return t.spark.read.parquet(path).select("ingest_id")


@query(
    "stream_daily_sales",
    """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS sale_date, o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_sales, count(*) AS transaction_count FROM orders GROUP BY 1, 2""",
)
def _(t):
    path = scratch_path(t.spark, "daily")
    s = streams(t).orders.select(
        text(F.to_date("o_orderdate")).alias("sale_date"), "o_orderstatus",
        F.date_format("o_orderdate", "yyyy").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )
    aggregates = {"total_sales": dbl(F.sum("amount")), "transaction_count": F.count("*")}
    jobs.daily_sales(s, path, ["year", "sale_date", "o_orderstatus"], aggregates, "year")
    return t.spark.read.parquet(path).select("sale_date", "o_orderstatus", "total_sales", "transaction_count")


@query("stream_lockout", lockout_sql("events").format(limit=5, minutes=30))
def _(t):
    attempts = streams(t).events.where(F.col("event_type").isin("error", "purchase")).select(
        "user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("ok")
    )
    return jobs.drain(jobs.lockout(attempts), "lockout")


@query("stream_validate_split", f"WITH {POS_SQL} SELECT k, n, len(e) = 0 AS is_valid, count(*) AS rows FROM errs GROUP BY ALL")
def _(t):
    good, bad = scratch_path(t.spark, "valid"), scratch_path(t.spark, "invalid")
    jobs.validate_split(pos_records(streams(t)), "pos", good, bad)
    both = t.spark.read.parquet(good).unionByName(t.spark.read.parquet(bad))
    return both.groupBy("k", "n", "is_valid").agg(F.count("*").alias("rows"))
