"""Downsampling against the plain algorithm, and other series operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.operators import series, updates


def plain_lttb(x, y, n):
    """Textbook form, one pass over arrays."""
    if len(x) <= n:
        return list(range(len(x)))
    every = (len(x) - 2) / (n - 2)
    bucket = [min(int((i - 1) / every), n - 3) for i in range(1, len(x) - 1)]
    groups = [[0]] + [[i + 1 for i, b in enumerate(bucket) if b == k] for k in range(n - 2)] + [[len(x) - 1]]
    picked = [0]
    for k in range(1, n - 1):
        mx, my = np.mean(x[groups[k + 1]]), np.mean(y[groups[k + 1]])
        a = picked[-1]
        area = [abs((x[a] - mx) * (y[i] - y[a]) - (x[a] - x[i]) * (my - y[a])) for i in groups[k]]
        picked.append(groups[k][int(np.argmax(area))])
    return picked + [len(x) - 1]


@pytest.mark.parametrize("n,points", [(3, 50), (20, 1000), (100, 997), (10, 10), (50, 7)])
def test_lttb(spark, n, points):
    rng = np.random.default_rng(points)
    x = np.cumsum(rng.random(points))
    y = rng.normal(size=points)
    df = spark.createDataFrame([("s", float(a), float(b), i) for i, (a, b) in enumerate(zip(x, y))], "s string, x double, y double, id long")
    got = [r.i for r in series.lttb(df.repartition(5), "s", "x", "y", n, "id").orderBy("i").collect()]
    assert got == plain_lttb(x, y, n)


def test_counter_restart(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate([5, 8, 2, 4])], "l string, s int, v long").withColumn("ts", F.timestamp_seconds("s"))
    assert series.increase(df, ["l"], "ts", "v", F.timestamp_seconds(F.lit(10)), "1 HOUR").first()["increase"] == 7


def test_cohort(spark):
    df = spark.createDataFrame([(1, "2024-01-05"), (1, "2024-02-01"), (2, "2024-01-09"), (3, "2024-02-02")], "u int, d string").withColumn("d", F.to_date("d"))
    cells = series.cohort_retention(df, "u", "d")
    got = {(str(r.cohort)[:7], r.period): r.retention for r in cells.collect()}
    assert got == {("2024-01", 0): 1.0, ("2024-01", 1): 0.5, ("2024-02", 0): 1.0}
    grid = series.cohort_grid(cells, 2).orderBy("cohort").collect()
    assert [(g["0"], g["1"]) for g in grid] == [(1.0, 0.5), (1.0, None)]


def test_depletion_in_order(spark, monkeypatch):
    rng = np.random.default_rng(5)
    stock = {k: int(rng.integers(0, 60)) for k in range(12)}
    asks = [(int(k), i, int(q)) for i, (k, q) in enumerate(zip(np.where(rng.random(2000) < 0.5, 0, rng.integers(0, 13, 2000)), rng.integers(0, 25, 2000)))]
    left, done, n = dict(stock), dict.fromkeys(stock, 0), dict.fromkeys(stock, 0)
    for k, _, q in asks:
        if k in left and q > 0:
            n[k] += 1
            if left[k] >= q:
                left[k] -= q
                done[k] += 1
    out = updates.deplete(
        spark.createDataFrame(list(stock.items()), "k int, s long"), spark.createDataFrame(asks, "k int, i int, q long"), "k", "s", "q", ["i"]
    )
    got = {r.k: (r.remaining, r.accepted, r.refused) for r in out.collect()}
    assert got == {k: (left[k], done[k], n[k] - done[k]) for k in stock}


def test_downsampling_plan_is_short_and_null_series_count(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 3 else "s", float(x), float(y), i) for i, (x, y) in enumerate(zip(np.cumsum(rng.random(3000)), rng.normal(size=3000)))]
    df = spark.createDataFrame(rows, "s string, x double, y double, id long").repartition(6)
    out = series.lttb(df, "s", "x", "y", 40, "id")
    for name in (None, "s"):
        mine = [r for r in rows if r[0] == name]
        got = [r.i for r in out.where(F.col("s").eqNullSafe(F.lit(name))).orderBy("i").collect()]
        assert got == plain_lttb(np.array([r[1] for r in mine]), np.array([r[2] for r in mine]), 40)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 6 and plan.count("Scan ExistingRDD") <= 2


@pytest.mark.parametrize("qs", [(0.5, 0.95), (0.0, 0.25, 1.0)])
def test_radix_selection_equals_exact_percentiles(spark, qs):
    rng = np.random.default_rng(7)
    hot = [("hot", float(v)) for v in rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000)]
    rows = hot + [(None, float(v)) for v in rng.integers(-3, 3, 50)] + [("one", -0.0), ("none", None), ("inf", float("-inf")), ("inf", 5.0), ("two", 1.5), ("two", None), ("two", 2.5)]
    df = spark.createDataFrame(rows, "l string, v double").repartition(5)
    got = {r.l: tuple(r)[1:] for r in series.quantiles(df, ["l"], "v", qs).collect()}
    want = {r.l: tuple(r)[1:] for r in df.groupBy("l").agg(*[F.percentile("v", q) for q in qs]).collect()}
    assert got.keys() == want.keys()
    for name in got:
        assert [None if g is None else repr(g + 0.0) for g in got[name]] == [None if w is None else repr(w + 0.0) for w in want[name]], name


def test_no_window_over_raw_samples(spark):
    df = spark.createDataFrame([("a", t, t % 7) for t in range(200)], "l string, s int, v long").withColumn("ts", F.timestamp_seconds("s"))
    for out in (series.increase(df, ["l"], "ts", "v", F.timestamp_seconds(F.lit(300)), "1 HOUR"), series.firing_for(df, ["l"], "ts", F.col("v") > 2, 2)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert all("_chunk" in line for line in plan.splitlines() if "Window [" in line)
    assert sorted((r.samples for r in series.firing_for(df, ["l"], "ts", F.col("v") > 2, 2).collect()))[-1] == 4
