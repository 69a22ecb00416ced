"""Outcomes of checks on the hundred-row user table and rule fusion."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillwise.operators import anomaly, quality

NOW = dt.datetime(2024, 1, 10)


@pytest.fixture(scope="module")
def users(spark):
    data = [
        (i, None if i % 10 == 0 else f"User_{i}", f"user{i}@test.com", 25 + i % 50, NOW - dt.timedelta(hours=i), 85.5 + i % 30 - 15)
        for i in range(1, 101)
    ]
    return spark.createDataFrame(data, "id int, name string, email string, age int, created_at timestamp, score double")


def rule(name, kind, column=None, threshold=0.0, **params):
    return {"name": name, "check_type": kind, "column": column, "threshold": threshold, "params": params, "severity": "HIGH"}


CASES = [
    (rule("rows", "row_count", min_rows=50, max_rows=200), True, 0, 100.0),
    (rule("few", "row_count", threshold=101), False, 1, 100.0),
    (rule("names", "null_rate", "name", 0.05), False, 10, 0.10),
    (rule("names ok", "null_rate", "name", 0.10), True, 10, 0.10),
    (rule("emails", "uniqueness", "email", 0), True, 0, 0.0),
    (rule("ages", "uniqueness", "age", min_uniqueness_rate=0.98), False, 50, 0.5),
    (rule("age range", "range_check", "age", 0, min_value=30, max_value=70), False, 18, 0.18),
    (rule("age kinds", "cardinality", "age", 50), True, 0, 50.0),
    (rule("age kinds gt", "cardinality", "age", 50, comparison="gt"), False, 1, 50.0),
    (rule("fresh", "timeliness", "created_at", 3600), True, 0, 3600.0),
    (rule("stale", "timeliness", "created_at", 60, grace_seconds=60), False, 1, 3600.0),
]


def test_fused_rules(users):
    got = {r.rule: r for r in quality.run_rules(users, [c[0] for c in CASES], F.lit(NOW)).collect()}
    for r, passed, violations, metric in CASES:
        x = got[r["name"]]
        assert (x.passed, x.violations_count, x.metric_value) == (passed, violations, pytest.approx(metric)), r["name"]


def test_fused_equals_separate(users):
    rules = [c[0] for c in CASES]
    fused = sorted(quality.run_rules(users, rules, F.lit(NOW)).collect())
    apart = sorted(row for r in rules for row in quality.run_rules(users, [r], F.lit(NOW)).collect())
    assert fused == apart


def test_one_scan_for_all_rules(users):
    plan = quality.run_rules(users, [c[0] for c in CASES if c[0]["check_type"] not in ("uniqueness", "cardinality")], F.lit(NOW))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_unknown_check(users):
    with pytest.raises(ValueError):
        quality.run_rules(users, [rule("x", "no_such_check")])


def test_disabled_rules_and_selection():
    rules = [dict(c[0], enabled=i % 2 == 0) for i, c in enumerate(CASES)]
    assert {r["name"] for r in quality.select_rules(rules, check_types=["timeliness"])} == {"fresh", "stale"}


def test_schema_drift(users):
    base = {"id": "int", "name": "string", "email": "string", "age": "bigint", "gone": "string"}
    assert quality.schema_drift(users, base) == [("age", "retyped"), ("created_at", "added"), ("gone", "removed"), ("score", "added")]
    assert quality.schema_drift(users, base, ignore_new=True, include_types=False) == [("gone", "removed")]


def history(spark, values, rule_id="r"):
    data = [(f"{rule_id}{i:04d}", rule_id, NOW + dt.timedelta(hours=i), int(v), 1000, 5.0, "SUCCESS") for i, v in enumerate(values)]
    return spark.createDataFrame(data, "run_id string, rule_id string, finished_at timestamp, violations_count long, rows_scanned long, duration_seconds double, status string")


def test_spike_is_found(spark):
    h = history(spark, [100] * 24 + [150, 50])
    for detect in (anomaly.statistical, anomaly.zscore, anomaly.iqr):
        found = {r.run_id for r in detect(h).where("is_anomaly").collect()}
        assert found == {"r0024", "r0025"}, detect.__name__


def test_short_history_and_constant_history(spark):
    assert anomaly.statistical(history(spark, [1] * 9)).count() == 0
    rows = anomaly.statistical(history(spark, [7] * 20)).collect()
    assert len(rows) == 5 and not any(r.is_anomaly for r in rows) and all(r.score is None for r in rows)


def test_change_point(spark):
    spike = anomaly.change_point(history(spark, [10] * 34 + [40] + [10] * 5), 0.05)
    assert {r.position: r.confidence for r in spike.where("is_anomaly").collect()} == {35: pytest.approx(1 / 3)}
    # three equal changes make a flat top; its middle, position 40, is the peak
    flat = anomaly.change_point(history(spark, [0] * 40 + [10] * 3 + [0] * 3), 0.05)
    assert {r.position: r.confidence for r in flat.where("is_anomaly").collect()} == {41: pytest.approx(1 / 2), 42: pytest.approx(1 / 3)}
    assert not any(r.is_anomaly for r in anomaly.change_point(history(spark, [10, 11] * 20), 0.04).collect())


def test_isolation_forest_ranks_the_outlier_first(spark):
    values = [100 + (i * 7919) % 13 for i in range(300)] + [1000]
    top = anomaly.isolation_forest(history(spark, values), 0.05).orderBy(F.desc("score")).first()
    assert top.run_id == "r0300" and top.is_anomaly


def test_volume_window():
    assert [anomaly.window_hours(s) for s in ("24h", "7d", "x")] == [24, 168, 24]
