"""Literal log fixtures for the detectors."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.operators import filters, joins, logs
from tillwise.sources import files

T0 = dt.datetime(2024, 1, 15, 10, 0, 0)
SCHEMA = "event_id long, ts timestamp, user_id string, ip string, action string, status int, endpoint string, message string, level string"


@pytest.fixture
def log(spark):
    def make(entries):
        return spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], SCHEMA)

    return make


def entry(seconds, user="u1", ip="1.1.1.1", action="view", status=200, endpoint="", message=""):
    return (T0 + dt.timedelta(seconds=seconds), user, ip, action, status, endpoint, message, "INFO")


def test_burst(log):
    df = log([entry(60 * i, action="login", status=401) for i in range(6)])
    rows = logs.failed_login_burst(df).collect()
    assert [(r.user_id, r["count"], r.first_seen, r.last_seen) for r in rows] == [("u1", 5, T0, T0 + dt.timedelta(minutes=5))]


def test_four_failures_are_no_burst(log):
    assert logs.failed_login_burst(log([entry(60 * i, action="login", status=401) for i in range(4)])).count() == 0


def test_export_spike(log):
    df = log([entry(i, action="data_Export") for i in range(12)])
    found = logs.export_spike(df)
    assert [(r.user_id, r["count"]) for r in found.collect()] == [("u1", 12)]
    assert logs.first_entries(df, found, "user_id").count() == 10


def test_api(log):
    assert [r["count"] for r in logs.suspicious_api(log([entry(i, endpoint="/a") for i in range(120)])).collect()] == [120]
    assert logs.suspicious_api(log([entry(i * 60, endpoint="/a") for i in range(120)])).count() == 0


def test_ip(log):
    rows = logs.report(log([entry(i, user=f"u{i}") for i in range(7)])).collect()
    assert [(r.type, r.description, r["count"]) for r in rows] == [("ip_multiple_users", "IP 1.1.1.1 accessed by 7 different users", 7)]


def test_nothing(log):
    assert logs.report(log([entry(0)]).limit(0)).count() == 0


@pytest.mark.parametrize("spec,kept", [("2024-01-15,2024-01-16", 1), ("2024-01-10,2024-01-12", 0), ("invalid-range", 1), ("a,b", 1)])
def test_range(log, spec, kept):
    assert log([entry(0)]).where(filters.log_time_range("ts", spec)).count() == kept


def test_bad_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "l.log").write_text('{"timestamp":"2024-01-15T10:00:00Z","level":"INFO","status":200}\n{"broken\n{"timestamp":"noon","level":"WARN"}\n')
    rows = files.scan_log(spark, str(tmp_path)).collect()
    assert sorted((r.level or "broken", r.ts is not None) for r in rows) == [("INFO", True), ("WARN", False), ("broken", False)]


def test_sessions_match_sessionize(spark):
    times = [0, 5, 9, 30, 31, 60]
    df = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=t), i) for i, t in enumerate(times)], "user_id int, ts timestamp, event_id int")
    got = sorted(r.requests for r in logs.sessions(df, "user_id", "ts", "event_id", 10).collect())
    assert got == [1, 2, 3]


def test_interval_join_with_merged_and_touching_intervals(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    iv = spark.createDataFrame([(1, t(1), t(5)), (1, t(3), t(8)), (1, t(8), t(9)), (2, t(1), t(2))], "k int, a timestamp, b timestamp")
    merged = joins.merge_intervals(iv, ["k"], "a", "b")
    assert sorted((r.k, r.a.day, r.b.day) for r in merged.collect()) == [(1, 1, 9), (2, 1, 2)]
    pts = spark.createDataFrame([(i, k, t(d)) for i, (k, d) in enumerate([(1, 1), (1, 8), (1, 9), (2, 2)])], "id int, k int, ts timestamp")
    assert sorted(r.id for r in joins.points_in_intervals(pts, merged, ["k"], "ts", "a", "b").collect()) == [0, 1]


@pytest.mark.parametrize("seed", range(3))
def test_every_overlapping_interval_that_covers_a_point(spark, seed):
    rng = np.random.default_rng(seed)
    at = lambda s: T0 + dt.timedelta(seconds=int(s))
    spans = []
    for i in range(120):
        a = int(rng.integers(0, 10_000))
        spans.append((i, int(rng.integers(0, 3)) if rng.random() < 0.5 else 0, at(a), at(a + int(rng.choice([0, 1, 50, 3000, 100_000])))))
    spans.append((999, 0, None, at(1)))
    points = [(i, int(rng.integers(0, 3)), at(rng.integers(-100, 12_000))) for i in range(300)] + [(900, 0, None), (901, None, at(5)), (902, 0, spans[0][2])]
    iv = spark.createDataFrame(spans, "c int, k int, a timestamp, b timestamp")
    pts = spark.createDataFrame(points, "i int, k int, ts timestamp")
    got = sorted((r.i, r.c) for r in joins.covering(pts, iv, ["k"], "ts", "a", "b").collect())
    want = sorted((i, c) for i, k, t in points for c, k2, a, b in spans if None not in (k, t, a) and k == k2 and a <= t < b)
    assert got == want and len(want) > 100
    assert joins.covering(pts, iv.limit(0), ["k"], "ts", "a", "b").count() == 0
    assert "NestedLoop" not in joins.covering(pts, iv, ["k"], "ts", "a", "b")._jdf.queryExecution().executedPlan().toString()


def test_integrity(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string").withColumn("h", logs.integrity_hash(["id", "x"], b"k"))
    assert logs.tampered(df, ["id", "x"], "h", b"k").count() == 0
    bad = df.withColumn("x", F.when(F.col("id") == 2, "c").otherwise(F.col("x")))
    assert [r.id for r in logs.tampered(bad, ["id", "x"], "h", b"k").collect()] == [2]
