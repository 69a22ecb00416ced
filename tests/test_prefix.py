"""Chunked prefix computations against pandas, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.functions import prefix


@pytest.fixture(params=[300, 7, 1], ids=["many-chunks", "some-chunks", "one-chunk"])
def chunk_rows(request, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 3000
    return pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 20, n)),  # key 0 is hot
            "t": rng.integers(0, 400, n),  # many ties
            "id": np.arange(n),
            "v": rng.integers(0, 50, n),
        }
    )


def test_running(spark, frame, chunk_rows):
    out = prefix.running(spark.createDataFrame(frame), ["k"], ["t", "id"], {"s": F.col("v")}, row_number="rn").toPandas()
    want = frame.sort_values(["k", "t", "id"])
    want["s"], want["rn"] = want.groupby("k")["v"].cumsum(), want.groupby("k").cumcount() + 1
    got = out.sort_values(["k", "t", "id"])
    assert got["s"].tolist() == want["s"].tolist() and got["rn"].tolist() == want["rn"].tolist()


@pytest.mark.parametrize("following", [False, True])
def test_neighbour(spark, frame, chunk_rows, following):
    out = prefix.previous(spark.createDataFrame(frame), ["k"], ["t", "id"], {"p": "v"}, following=following).toPandas()
    want = frame.sort_values(["k", "t", "id"])
    want["p"] = want.groupby("k")["v"].shift(-1 if following else 1)
    got = out.sort_values(["k", "t", "id"])
    assert got["p"].astype(float).fillna(-1).tolist() == want["p"].fillna(-1).tolist()


def test_max_before(spark, frame, chunk_rows):
    out = prefix.max_before(spark.createDataFrame(frame), ["k"], ["t", "id"], "v", "m").toPandas().sort_values(["k", "t", "id"])
    want = frame.sort_values(["k", "t", "id"])
    want["m"] = want.groupby("k")["v"].transform(lambda s: s.cummax().shift(1))
    assert out["m"].astype(float).fillna(-1).tolist() == want["m"].fillna(-1).tolist()


def test_trailing_count(spark, frame, chunk_rows):
    sdf = spark.createDataFrame(frame).withColumn("ts", F.timestamp_seconds("t"))
    out = prefix.trailing_count(sdf, ["k"], "ts", "id", 25, "c").toPandas().set_index("id")["c"]
    for _, g in frame.groupby("k"):
        t = g["t"].to_numpy()
        for i, at in zip(g["id"], t):
            assert out[i] == int(((t >= at - 25) & (t <= at)).sum())


def test_chunks_are_even_and_ordered(spark):
    df = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("x"))
    sizes = prefix.cut(df, ["x"]).groupBy(prefix.CHUNK).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy(prefix.CHUNK).collect()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r.n for r in sizes) < 2 * 20000 / len(sizes)
    assert all(p.b < q.a for p, q in zip(sizes, sizes[1:]))


def test_null_keys_and_null_order_values(spark, chunk_rows):
    rows = [(None, None, 1, 5), (None, 3, 2, 6), (None, 4, 3, None), ("a", None, 4, 1), ("a", 2, 5, 2), (None, None, 6, 7)]
    df = spark.createDataFrame(rows, "k string, t int, id int, v int")
    out = {r.id: r for r in prefix.running(df, ["k"], ["t", "id"], {"s": F.col("v")}, row_number="rn").collect()}
    assert {i: (r.s, r.rn) for i, r in out.items()} == {1: (5, 1), 6: (12, 2), 2: (18, 3), 3: (18, 4), 4: (1, 1), 5: (3, 2)}
    before = {r.id: r.p for r in prefix.previous(df, ["k"], ["t", "id"], {"p": "id"}).collect()}
    assert before == {1: None, 6: 1, 2: 6, 3: 2, 4: None, 5: 4}
    top = {r.id: r.m for r in prefix.max_before(df, ["k"], ["t", "id"], "v", "m").collect()}
    assert top == {1: None, 6: 5, 2: 7, 3: 7, 4: None, 5: 1}


@pytest.mark.parametrize("values", [[5.0], [1.0, 1.0, 1.0], list(range(1000)), [0.1] * 700 + list(range(300)), [-3.5, 1e-9, 2e-9, 7.0]])
def test_values_at_ranks(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = prefix.values_at_ranks(df, "v", [0.0, 0.25, 0.5, 0.75, 0.999], bins=8)
    s = sorted(values)
    assert got == [s[min(int(len(s) * q), len(s) - 1)] for q in [0.0, 0.25, 0.5, 0.75, 0.999]]


def test_values_at_ranks_of_nothing(spark):
    assert prefix.values_at_ranks(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


@pytest.mark.parametrize("extra", [[float("nan")], [float("inf"), float("-inf")], [1e308, -1e308], [5e-324, 1e-323]])
def test_values_at_ranks_ends_on_extreme_values(spark, extra):
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, None, *extra]], "v double")
    finite = sorted([1.0, 2.0, 3.0, *[v for v in extra if abs(v) < float("inf")]])
    assert prefix.values_at_ranks(df, "v", [0.0, 0.5, 0.99]) == [finite[int(len(finite) * q)] for q in (0.0, 0.5, 0.99)]
