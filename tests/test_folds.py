"""Folds over keys that reach over many chunks."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.functions.prefix import CHUNK
from tillwise.operators import folds

T0 = dt.datetime(2024, 1, 1)


def run(machine, state, rows):
    outs = []
    for r in rows:
        state, out = machine.step(state, *r)
        outs.append(out)
    return state, outs


def look_up(machine, state, table):
    for slot, at in machine.places(state):
        for s, low, high, end in table:
            if s == slot and low <= at < high:
                return machine.after(state, end)
    return state


def alike(machine, a, b, rows):
    """Whether two states judge all that may follow alike."""
    return run(machine, a, rows)[1] == run(machine, b, rows)[1]


@pytest.mark.parametrize("seed", range(40))
def test_tables_tell_the_end_from_any_start(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    at = np.sort(rng.integers(100, 100 + int(rng.integers(5, 300)), n)).tolist()
    later = [(400 + 3 * k, *rest) for k, rest in enumerate([(bool(rng.integers(0, 4) == 0),) for _ in range(60)])]
    lock = folds.Lockout(int(rng.integers(1, 4)), int(rng.integers(1, 80)))
    ok = [bool(x) for x in rng.random(n) < 0.2]
    table = lock.table(at, ok)
    for _ in range(60):
        fails = int(rng.integers(0, 7))
        start = (fails, int(rng.integers(60, 100 + lock.hold)) if fails >= lock.limit else folds.LONG_AGO)
        want, _ = run(lock, start, zip(at, ok, strict=True))
        got = look_up(lock, start, table)
        assert got[0] == want[0] and alike(lock, got, want, later)
    limit = folds.RateLimit()
    most, hold = rng.choice([0, 1, 3, 9], n).tolist(), rng.choice([5, 20, 60], n).tolist()
    table = limit.table(at, most, hold)
    for _ in range(60):
        start = (int(rng.integers(0, 12)), int(rng.integers(60, 500)))
        want, _ = run(limit, start, zip(at, most, hold, strict=True))
        got = look_up(limit, start, table)
        later = [(500 + 2 * k, 3, 20) for k in range(40)]
        assert got == want and alike(limit, got, want, later)


def test_a_user_with_half_of_all_rows_lies_in_many_chunks(spark):
    rng = np.random.default_rng(3)
    n = 4000
    rows = [(i, 1 if rng.random() < 0.5 else (None if rng.random() < 0.1 else int(rng.integers(2, 40))), T0 + dt.timedelta(seconds=int(rng.integers(0, 40_000))), bool(rng.random() < 0.1)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, user long, ts timestamp, ok boolean")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = folds.lockout(df, "user", "ts", "id", F.col("ok"), limit=3, minutes=7).collect()
        parts = folds.cut(df, ["user", "ts", "id"])
        assert parts.where("user = 1").select(CHUNK).distinct().count() >= 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    machine = folds.Lockout(3, 7 * 60_000_000)
    want = {}
    for user in {r[1] for r in rows}:
        mine = sorted((r[2], r[0], r[3]) for r in rows if r[1] == user)
        _, outs = run(machine, machine.start, [(int((t - T0).total_seconds() * 1e6), ok) for t, _, ok in mine])
        want |= {m[1]: o for m, o in zip(mine, outs, strict=True)}
    assert {r.id: (r.outcome, r.failures) for r in got} == want and len(got) == n
    assert {o[0] for o in want.values()} == {"accepted", "failed", "locked", "refused"}


def test_rate_limit_of_one_busy_address_equals_the_counters_in_order(spark):
    rng = np.random.default_rng(5)
    n = 3000
    rows = [(i, T0 + dt.timedelta(seconds=int(rng.integers(0, 9000))), "a" if rng.random() < 0.6 else f"b{rng.integers(0, 9)}",
             None if rng.random() < 0.3 else int(rng.integers(0, 5)), [None, "x", "y"][rng.integers(0, 3)]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, ip string, user_id long, endpoint string")
    most = F.when(F.col("endpoint") == "x", 4).when(F.col("user_id").isNotNull(), 9).otherwise(6)
    hold = F.when(F.col("endpoint") == "x", 90).otherwise(60)
    out = folds.rate_limit(df, "ts", "id", most, hold)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # each counter is folded once, over a written cut
    got = {r.id: r.refused_by for r in out.collect()}
    counters, want = {}, {}
    for i, ts, ip, user, endpoint in sorted(rows, key=lambda r: (r[1], r[0])):
        at, want[i] = ts.timestamp(), None
        allowed = 4 if endpoint == "x" else 9 if user is not None else 6
        for name, key in (("ip", ip), ("user", user), ("endpoint", endpoint and (endpoint, ip))):
            if key is None:
                continue
            count, end = counters.get((name, key), (0, 0))
            count = 0 if at >= end else count
            if count >= allowed:
                want[i] = name
                break
            counters[(name, key)] = (count + 1, at + (90 if endpoint == "x" else 60))
    assert got == want and {"ip", "user", None} <= set(want.values())
