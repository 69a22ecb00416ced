"""Every catalogue query runs; where it has reference SQL, both must agree."""

import duckdb
import pytest

from tillwise.plans import registry
from tools.check import TABLES, rows_of

QUERIES = registry.spark_queries()
SQL = registry.reference_sql()
# at the smallest scale some thresholds are not reached
MAY_BE_EMPTY = {
    "filter_branch", "filter_sales", "filter_inventory", "filter_logs", "filter_staff_performance", "win_brute_force",
    "win_local_peaks", "log_failed_login_burst", "log_burst_entries", "log_suspicious_api", "anom_store", "log_export_spike",
    "stream_failed_login_burst", "stream_brute_force", "stream_rate_sessions", "sec_rate_limit", "alert_threshold_for",
    "upd_bulk_stock", "filter_customer", "join_item_iexact", "agg_expiry", "pii_scan_table", "scan_document", "scan_table_query",
}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got or name in MAY_BE_EMPTY
        return
    cur = duck.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cur.fetchall())


def test_catalogue_loads_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    names, texts = (set(line.split()) for line in done.stdout.splitlines())
    # further queries come from parts that can be left out
    assert set(QUERIES) <= names and set(SQL) <= texts <= names


def test_as_of_filters_prune_files(spark, tmp_path):
    """A filter "last N days" reads no file that lies before it."""
    from pyspark.sql import functions as F

    from tillwise.operators import marts
    from tillwise.session import configure

    configure(spark)
    path = str(tmp_path / "events")
    rows = spark.range(20_000).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).alias("ts"))
    rows.repartitionByRange(20, "ts").write.parquet(path)
    df = spark.read.parquet(path)
    as_of = marts.max_of(df, "ts")
    for recent in (df.where(F.col("ts") >= as_of - F.expr("INTERVAL 2 DAYS")), df.where(F.to_date("ts") >= F.date_sub(as_of, 2))):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            frame = recent.select("id")
            frame.collect()
            plan = frame._jdf.queryExecution().executedPlan()
            leaves = plan.collectLeaves()
            read = sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert 0 < read <= 3_000
    assert marts.max_of(df.where("id < 0"), "ts") is not None


def test_paged_json_reads_every_error(spark, tmp_path):
    # pages of 25 errors in bare lists: no envelope names a last page
    events = spark.range(0, 2000, 10).selectExpr("id AS event_id", "id AS user_id", "'error' AS event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["scan_paged_json"](spark, str(tmp_path)).count() == 200
