"""Streaming jobs over several files in time order, against their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillwise.operators import logs
from tillwise.streaming import idindex, jobs

T0 = dt.datetime(2024, 1, 1)


def write_files(spark, path, frames):
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def login_files(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "event_id long, ts timestamp, user_id string, action string, status int"
    rows = [[(k * 100 + i, T0 + dt.timedelta(minutes=20 * k, seconds=20 * i), f"u{i % 2}", "login", 401) for i in range(12)] for k in range(4)]
    # arrives last and is hours late
    rows.append([(900 + i, T0 - dt.timedelta(hours=5), "u9", "login", 401) for i in range(9)])
    write_files(spark, path, [spark.createDataFrame(r, schema) for r in rows])
    return path, spark.read.parquet(path)


def test_burst_equals_batch_on_closed_windows_and_drops_late_rows(spark, login_files):
    path, batch = login_files
    stream = jobs.source(spark, path, batch.schema, files_per_trigger=1)
    got = {(r.user_id, r.first_seen, r["count"]) for r in jobs.drain(jobs.failed_login_burst(stream), "t").collect()}
    closed = batch.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    want = {(r.user_id, r.first_seen, r["count"]) for r in logs.failed_login_burst(batch.where("user_id <> 'u9'")).collect() if r.last_seen <= closed}
    assert got == want and want


def simulate_lockout(attempts, limit=5, minutes=30):
    fails, until, out = {}, {}, {}
    for at, event, user, ok in sorted(attempts):
        if at < until.get(user, 0):
            out[event] = "refused"
        elif ok:
            fails[user], out[event] = 0, "accepted"
        else:
            fails[user] = fails.get(user, 0) + 1
            out[event] = "failed"
            if fails[user] >= limit:
                until[user], out[event] = at + minutes * 60, "locked"
    return out


def test_lockout(spark, tmp_path):
    import random

    rnd = random.Random(4)
    attempts = [(60 * i + rnd.random(), i, rnd.randint(0, 3), rnd.random() < 0.15) for i in range(600)]
    schema = "at double, event_id long, user_id long, ok boolean"
    path = str(tmp_path / "in")
    parts = [spark.createDataFrame(attempts[i : i + 150], schema).withColumn("ts", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("long"))).drop("at") for i in range(0, 600, 150)]
    write_files(spark, path, parts)
    stream = jobs.source(spark, path, parts[0].schema, files_per_trigger=1)
    got = {r.event_id: r.outcome for r in jobs.drain(jobs.lockout(stream), "lock").collect()}
    assert got == simulate_lockout([(round(a * 1e6) / 1e6, e, u, ok) for a, e, u, ok in attempts])
    assert {"accepted", "failed", "locked", "refused"} == set(got.values())


def test_dedup_over_files(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "ingest_id string, created_at timestamp"
    write_files(spark, path, [spark.createDataFrame([(f"a{i % 3}", T0 + dt.timedelta(hours=k))  for i in range(6)], schema) for k in range(3)])
    stream = jobs.source(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    jobs.dedup(stream, out)
    assert sorted(r.ingest_id for r in spark.read.parquet(out).collect()) == ["a0", "a1", "a2"]
    # the same files once more, as after a restart: nothing new
    jobs.dedup(jobs.source(spark, path, spark.read.parquet(path).schema, files_per_trigger=3), out)
    assert spark.read.parquet(out).count() == 3


def test_daily_sales_accumulates_over_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "year string, day string, amount long"
    write_files(spark, src, [spark.createDataFrame([("2024", "d1", 1), ("2024", "d2", k)], schema) for k in (1, 2, 3)])
    stream = jobs.source(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
    jobs.daily_sales(stream, out, ["year", "day"], {"total": F.sum("amount"), "n": F.count("*")}, "year")
    assert sorted((r.day, r.total, r.n) for r in spark.read.parquet(out).collect()) == [("d1", 3, 3), ("d2", 6, 3)]


def test_split_keeps_every_row(spark, tmp_path):
    src, good, bad = (str(tmp_path / n) for n in ("in", "good", "bad"))
    schema = "uploaded_at string, x long"
    write_files(spark, src, [spark.createDataFrame([("t", k), ("", k), (None, k)], schema) for k in range(3)])
    stream = jobs.source(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
    jobs.validate_split(stream, "csv_upload", good, bad)
    assert (spark.read.parquet(good).count(), spark.read.parquet(bad).count()) == (3, 6)


def test_id_index_opens_only_buckets_whose_filter_hits(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    opened = []
    real = idindex._read

    def watched(spark_, root_, schema, paths):
        df = real(spark_, root_, schema, paths)
        if root_.endswith("/ids"):
            opened.append(len(df.inputFiles()) if paths else 0)
        return df

    monkeypatch.setattr(idindex, "_read", watched)
    monkeypatch.setattr(idindex, "_compact", lambda *a: None)
    batch = lambda k, n=40: spark.createDataFrame([(f"id{k}-{i}", k) for i in range(n)], "ingest_id string, k int")
    for k in range(6):
        assert idindex.claim(batch(k), "ingest_id", root, k, 4).count() == 40
    assert opened == [0] * 6  # new ids open nothing, however long the history
    assert idindex.claim(batch(0).limit(1).unionByName(spark.createDataFrame([("new", 9), (None, 1)], "ingest_id string, k int")), "ingest_id", root, 6, 4).collect() == [("new", 9)]
    assert 0 < opened[-1] <= 7
    # the same batch once more, as after a failure, gives the same rows
    assert idindex.claim(spark.createDataFrame([("new", 9)], "ingest_id string, k int"), "ingest_id", root, 6, 4).collect() == [("new", 9)]


def test_id_index_keeps_few_parts_and_refuses_repeats_of_any_age(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idindex, "MOST_PARTS", 3)
    root = str(tmp_path / "index")
    batch = lambda k: spark.createDataFrame([(k * 1000 + i,) for i in range(30)], "ingest_id long")
    for k in range(9):
        assert idindex.claim(batch(k), "ingest_id", root, k, 2).count() == 30
        assert all(len(idindex._children(spark, f"{root}/ids/bucket={b}")) <= 4 for b in range(2))
    for k in range(9):
        assert idindex.claim(batch(k), "ingest_id", root, 20 + k, 2).count() == 0


def test_filters_know_their_ids():
    import numpy as np

    rng = np.random.default_rng(0)
    ids, others = rng.integers(-(2**63), 2**63 - 1, 5000), rng.integers(-(2**63), 2**63 - 1, 5000)
    bits = idindex.with_ids(idindex.with_ids(None, ids), ids[:10])
    assert idindex.may_hold(bits, ids).all() and idindex.may_hold(bits, others).mean() < 0.05


def test_lockout_state_ends(spark, tmp_path):
    path, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    schema = "user_id long, event_id long, ts timestamp, ok boolean"
    day = dt.timedelta(days=1)
    rows = [
        [(1, 1, T0, False), (2, 2, T0, False), (3, 3, T0, True)],
        [(2, 4, T0 + day, True), (9, 5, T0 + 5 * day, True)],
        [(9, 6, T0 + 6 * day, True)],
    ]
    write_files(spark, path, [spark.createDataFrame(r, schema) for r in rows])
    stream = jobs.source(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    found = jobs.lockout(stream, forget_days=2)
    q = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    assert {r.event_id: r.outcome for r in spark.read.parquet(out).collect()} == {1: "failed", 2: "failed", 3: "accepted", 4: "accepted", 5: "accepted", 6: "accepted"}
    left = spark.read.format("statestore").option("stateVarName", "lock").load(state)
    assert left.count() == 0


def test_open_failures_are_forgotten_within_a_batch_too(spark, tmp_path):
    path = str(tmp_path / "in")
    day = dt.timedelta(days=1)
    rows = [(1, k, T0 + k * 3 * day, False) for k in range(6)] + [(2, 10 + k, T0 + k * dt.timedelta(minutes=1), False) for k in range(6)]
    write_files(spark, path, [spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, ok boolean")])
    got = {r.event_id: r.outcome for r in jobs.drain(jobs.lockout(jobs.source(spark, path, spark.read.parquet(path).schema), forget_days=2), "lock").collect()}
    assert [got[k] for k in range(6)] == ["failed"] * 6
    assert [got[10 + k] for k in range(6)] == ["failed"] * 4 + ["locked", "refused"]


def test_validated_rows_are_kept_in_even_parts(spark, tmp_path):
    # one file of one split; what is kept of it is dealt to several tasks
    from tillwise.plans.streams import streams
    from tillwise.plans.standins import Tables
    from tillwise.plans.validation import pos_records

    lines = spark.range(20_000).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "id % 7 + 1 AS l_linenumber", "CAST(id % 50 AS double) AS l_quantity", "timestamp'1995-01-01' AS l_shipdate"
    )
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    try:
        for k in old:
            spark.conf.set(k, "4k")
        jobs.validate_split(pos_records(streams(Tables(spark, str(tmp_path)))), "pos", good, bad)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert spark.read.parquet(good).count() + spark.read.parquet(bad).count() == 20_000
    assert len(list((tmp_path / "good").rglob("part-*.parquet"))) > 1
