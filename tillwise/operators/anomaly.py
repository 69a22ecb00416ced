"""Anomaly detection on run histories.

A history has one row per rule and run: it is already aggregated, so windows
per rule are bounded by the number of runs. Mean and deviation are windows
over the rule; the last five runs are judged.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.columns import dbl

LAST = 5
MIN_HISTORY = 10


def _history(runs: DataFrame, value: str, minimum: int, last: int | None = LAST) -> DataFrame:
    """Rule statistics on every row, and the position from the end."""
    rule = Window.partitionBy("rule_id")
    back = Window.partitionBy("rule_id").orderBy(F.desc("finished_at"), F.desc("run_id"))
    v = dbl(value)
    out = runs.withColumns(
        {
            "_v": v,
            "_n": F.count("*").over(rule),
            "_mean": F.avg(v).over(rule),
            "_std": F.stddev_pop(v).over(rule),
            "_back": F.row_number().over(back),
        }
    ).where(F.col("_n") >= minimum)
    return out.where(F.col("_back") <= last) if last else out


def _z_rows(runs: DataFrame, threshold: float, method: str) -> DataFrame:
    h = _history(runs, "violations_count", MIN_HISTORY)
    z = F.when(F.col("_std") > 0, F.abs(F.col("_v") - F.col("_mean")) / F.col("_std"))
    hit = F.when(F.col("_std") > 0, z > threshold).otherwise(F.col("_v") != F.col("_mean"))
    confidence = F.when(hit, F.when(F.col("_std") > 0, F.least(z / threshold, F.lit(1.0))).otherwise(1.0)).otherwise(0.0)
    return h.select(
        "rule_id",
        "run_id",
        F.lit(method).alias("method"),
        hit.alias("is_anomaly"),
        confidence.alias("confidence"),
        F.lit(threshold).alias("threshold_value"),
        F.col("_v").alias("actual_value"),
        F.greatest(F.lit(0.0), F.col("_mean") - F.col("_std") * threshold).alias("expected_min"),
        (F.col("_mean") + F.col("_std") * threshold).alias("expected_max"),
        z.alias("score"),
    )


def statistical(runs: DataFrame, sensitivity: float = 0.05) -> DataFrame:
    """z-score against the two-sided normal quantile."""
    return _z_rows(runs, NormalDist().inv_cdf(1 - sensitivity / 2), "statistical")


def z_threshold(sensitivity: float) -> float:
    return 3.5 if sensitivity < 0.01 else 2.5 if sensitivity > 0.05 else 3.0


def zscore(runs: DataFrame, sensitivity: float = 0.05) -> DataFrame:
    return _z_rows(runs, z_threshold(sensitivity), "z_score")


def iqr(runs: DataFrame, sensitivity: float = 0.05, last: int = LAST) -> DataFrame:
    """Interpolated quartiles; the multiplier follows the sensitivity."""
    k = 2.0 if sensitivity < 0.01 else 1.0 if sensitivity > 0.05 else 1.5
    quartiles = runs.groupBy("rule_id").agg(
        F.percentile(dbl("violations_count"), F.array(F.lit(0.25), F.lit(0.75))).alias("_q")
    )
    h = _history(runs, "violations_count", MIN_HISTORY, last).join(quartiles, "rule_id")
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    spread = q3 - q1
    low, high = q1 - spread * k, q3 + spread * k
    hit = (F.col("_v") < low) | (F.col("_v") > high)
    distance = F.least(F.abs(F.col("_v") - low), F.abs(F.col("_v") - high))
    confidence = F.when(hit & (spread > 0), F.least(distance / (spread * k), F.lit(1.0))).otherwise(0.0)
    return h.select(
        "rule_id", "run_id", F.lit("iqr").alias("method"), hit.alias("is_anomaly"), confidence.alias("confidence"),
        F.lit(k).alias("threshold_value"), F.col("_v").alias("actual_value"),
        F.greatest(F.lit(0.0), low).alias("expected_min"), high.alias("expected_max"),
    )


def change_point(runs: DataFrame, sensitivity: float = 0.05, last: int = LAST) -> DataFrame:
    """Peaks in the change of a rolling mean near the last runs.

    The window length ``min(n / 4, 10)`` differs by rule, so the rolling mean is
    the difference of two running sums looked up ``w`` rows back.
    """
    factor = 3.0 if sensitivity < 0.05 else 2.0
    rule = Window.partitionBy("rule_id")
    order = rule.orderBy("finished_at", "run_id")
    h = runs.select("rule_id", "run_id", "finished_at", dbl("violations_count").alias("v")).withColumns(
        {
            "n": F.count("*").over(rule),
            "pos": F.row_number().over(order) - 1,
            "run": F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).where(F.col("n") >= MIN_HISTORY)
    h = h.withColumn("w", F.least(F.floor(F.col("n") / 4), F.lit(10)).cast("int"))
    lags = [F.lag("run", k).over(order) for k in range(1, 11)]
    back = F.element_at(F.array(*lags), F.col("w"))
    total = F.col("run") - F.coalesce(back, F.lit(0.0))
    h = h.withColumn("mean", F.when(F.col("pos") >= F.col("w") - 1, total / F.col("w")))
    # the change at position i lies between the means at i and i + 1
    h = h.withColumn("change", F.lead("mean").over(order) - F.col("mean"))
    h = h.withColumns({"height": F.stddev_pop("change").over(rule) * factor, "size": F.abs("change")})
    # a flat top counts once, at its middle
    h = h.withColumn("top", F.sum(F.when(~F.col("size").eqNullSafe(F.lag("size").over(order)), 1).otherwise(0)).over(order))
    h = h.withColumns({"left": F.lag("size").over(order), "right": F.lead("size").over(order)})
    run = Window.partitionBy("rule_id", "top")
    h = h.withColumns({"first": F.min("pos").over(run), "last": F.max("pos").over(run)})
    h = h.withColumns(
        {
            "left": F.max(F.when(F.col("pos") == F.col("first"), F.col("left"))).over(run),
            "right": F.max(F.when(F.col("pos") == F.col("last"), F.col("right"))).over(run),
        }
    )
    middle = F.col("pos") == F.floor((F.col("first") + F.col("last")) / 2)
    peak = middle & (F.col("size") > F.col("left")) & (F.col("size") > F.col("right")) & (F.col("size") >= F.col("height"))
    h = h.withColumn("peak", F.when(peak, F.col("pos")))
    # the nearest peak at most 2 positions away
    distances = [F.when(F.lag("peak", k).over(order).isNotNull(), k) for k in (0, 1, 2)] + [
        F.when(F.lead("peak", k).over(order).isNotNull(), k) for k in (1, 2)
    ]
    near = F.least(*distances)
    tail = h.withColumn("near", near).where(F.col("pos") >= F.col("n") - last)
    hit = F.col("near").isNotNull()
    return tail.select(
        "rule_id", "run_id", F.lit("change_point").alias("method"), hit.alias("is_anomaly"),
        F.when(hit, 1.0 / (F.col("near") + 1)).otherwise(0.0).alias("confidence"),
        F.col("height").alias("threshold_value"), F.col("v").alias("actual_value"), F.col("pos").alias("position"),
    )


def seasonal(runs: DataFrame, phase: Column, method: str, threshold: float = 3.0, minimum: int = 14) -> DataFrame:
    """z-score against the runs of the same phase (hour of day, day of week)."""
    p = runs.withColumns({"phase": phase, "_v": dbl("violations_count")})
    stats = p.groupBy("rule_id", "phase").agg(F.avg("_v").alias("_mean"), F.stddev_pop("_v").alias("_std"))
    sizes = p.groupBy("rule_id").agg(F.count("*").alias("_n"))
    last = p.withColumn(
        "_back", F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("finished_at"), F.desc("run_id")))
    ).where(F.col("_back") <= LAST)
    j = last.join(stats, ["rule_id", "phase"]).join(sizes, "rule_id").where(F.col("_n") >= minimum)
    z = F.when(F.col("_std") > 0, F.abs(F.col("_v") - F.col("_mean")) / F.col("_std"))
    hit = F.coalesce(z > threshold, F.lit(False))
    return j.select(
        "rule_id", "run_id", F.lit(method).alias("method"), hit.alias("is_anomaly"),
        F.when(hit, F.least(z / threshold, F.lit(1.0))).otherwise(0.0).alias("confidence"), F.col("_v").alias("actual_value"),
    )


def _volume(runs: DataFrame, hours: int, as_of: Column) -> DataFrame:
    """Newest positive volume per rule and the earlier ones inside the window."""
    recent = runs.where((F.col("rows_scanned") > 0) & (F.col("finished_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")))
    back = Window.partitionBy("rule_id").orderBy(F.desc("finished_at"), F.desc("run_id"))
    return recent.withColumns({"_back": F.row_number().over(back), "_v": dbl("rows_scanned")})


def window_hours(spec: str) -> int:
    """``24h`` or ``7d`` as hours; 24 for anything else."""
    if spec[-1:] == "h":
        return int(spec[:-1])
    if spec[-1:] == "d":
        return int(spec[:-1]) * 24
    return 24


def volume_statistical(runs: DataFrame, as_of: Column, window: str = "24h", method="volume_statistical") -> DataFrame:
    v = _volume(runs, window_hours(window), as_of)
    past = F.when(F.col("_back") > 1, F.col("_v"))
    s = v.groupBy("rule_id").agg(
        F.max(F.when(F.col("_back") == 1, F.col("_v"))).alias("cur"), F.avg(past).alias("mean"), F.stddev_pop(past).alias("std"), F.count(past).alias("n")
    ).where("n >= 5")
    z = F.when(F.col("std") > 0, F.abs(F.col("cur") - F.col("mean")) / F.col("std"))
    hit = F.when(F.col("std") > 0, z > 3.0).otherwise(F.col("cur") != F.col("mean"))
    return s.select(
        "rule_id", F.lit(method).alias("method"), hit.alias("is_anomaly"),
        F.when(hit, F.least(F.coalesce(z / 3.0, F.lit(1.0)), F.lit(1.0))).otherwise(0.0).alias("confidence"),
        F.col("cur").alias("actual_value"), F.col("n").alias("history_size"), F.coalesce(z, F.lit(0.0)).alias("score"),
    )


def volume_iqr(runs: DataFrame, as_of: Column, window: str = "24h") -> DataFrame:
    v = _volume(runs, window_hours(window), as_of)
    past = F.when(F.col("_back") > 1, F.col("_v"))
    s = v.groupBy("rule_id").agg(
        F.max(F.when(F.col("_back") == 1, F.col("_v"))).alias("cur"),
        F.percentile(past, F.array(F.lit(0.25), F.lit(0.75))).alias("q"),
        F.count(past).alias("n"),
    ).where("n >= 5")
    q1, q3 = F.col("q")[0], F.col("q")[1]
    low, high = q1 - (q3 - q1) * 1.5, q3 + (q3 - q1) * 1.5
    hit = (F.col("cur") < low) | (F.col("cur") > high)
    return s.select(
        "rule_id", F.lit("volume_iqr").alias("method"), hit.alias("is_anomaly"), F.col("cur").alias("actual_value"),
        F.greatest(F.lit(0.0), low).alias("expected_min"), high.alias("expected_max"), F.col("n").alias("history_size"),
    )


def only_anomalies(found: DataFrame) -> DataFrame:
    """What is stored: anomalies with score and range."""
    return found.where("is_anomaly").select(
        "rule_id", "run_id", F.col("method").alias("detection_method"), F.col("confidence").alias("anomaly_score"),
        "threshold_value", "actual_value", "expected_min", "expected_max",
    )


# --- isolation forest (Liu, Ting, Zhou 2008) --------------------------------

FEATURES = ("violations_count", "rows_scanned", "duration_seconds")


def _average_path(n):
    """Mean path length of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, depth: int, limit: int, rng, nodes: list) -> int:
    """Append the nodes of a random tree; returns the root's position."""
    me = len(nodes)
    nodes.append(None)
    spans = np.ptp(x, axis=0) if len(x) else np.zeros(x.shape[1])
    usable = np.flatnonzero(spans > 0)
    if depth >= limit or len(x) <= 1 or not len(usable):
        nodes[me] = (-1, float(depth + _average_path(len(x))), -1, -1)
        return me
    f = int(rng.choice(usable))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    a = _grow(x[left], depth + 1, limit, rng, nodes)
    b = _grow(x[~left], depth + 1, limit, rng, nodes)
    nodes[me] = (f, cut, a, b)
    return me


def forest(scaled: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """One random tree per tree id, grown from at most ``sample`` rows.

    Every row draws a digest per tree; the smallest digests form the sample. A
    Bernoulli share keeps only a few candidates per tree before the ranking,
    so no tree sees more than a bounded number of rows.
    """
    n = scaled.count()
    share = min(1.0, 4.0 * sample / max(n, 1))
    draw = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("run_id")), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share)
    drawn = scaled.select("run_id", *FEATURES, F.explode(chosen).alias("tree"))
    w = Window.partitionBy("tree").orderBy(draw(F.col("tree")), "run_id")
    picked = drawn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = pdf.sort_values("_r")[list(FEATURES)].to_numpy(dtype=float)
        nodes: list = []
        _grow(x, 0, int(np.ceil(np.log2(max(len(x), 2)))), rng, nodes)
        f, v, a, b = zip(*nodes)
        return pd.DataFrame({"tree": tree, "size": len(x), "feature": [list(f)], "value": [list(v)], "left": [list(a)], "right": [list(b)]})

    return picked.groupBy("tree").applyInPandas(
        grow, "tree long, size long, feature array<int>, value array<double>, left array<int>, right array<int>"
    )


def isolation_forest(runs: DataFrame, sensitivity: float = 0.05, trees: int = 100, seed: int = 42) -> DataFrame:
    """Score of every run, and the share ``min(sensitivity, 0.3)`` with the
    highest scores marked.

    The fitted forest is bounded (trees x 2 x 256 nodes) and travels inside the
    scoring function; scoring is a pandas UDF over partitions.
    """
    stats = runs.agg(*[F.avg(dbl(f)).alias(f"{f}_m") for f in FEATURES], *[F.stddev_pop(dbl(f)).alias(f"{f}_s") for f in FEATURES]).first()
    scaled = runs.select(
        "rule_id", "run_id", "finished_at",
        *[((dbl(f) - (stats[f"{f}_m"] or 0.0)) / (stats[f"{f}_s"] or 1.0)).alias(f) for f in FEATURES],
    )
    model = [
        (r.size, np.array(r.feature), np.array(r.value), np.array(r.left), np.array(r.right))
        for r in forest(scaled, trees, seed=seed).collect()
    ]

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        x = np.column_stack([a, b, c]).astype(float)
        total = np.zeros(len(x))
        for size, feature, value, left, right in model:
            at = np.zeros(len(x), dtype=int)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                node = at[rows]
                go_left = x[rows, feature[node]] < value[node]
                at[rows] = np.where(go_left, left[node], right[node])
            total += value[at] / _average_path(size)
        return pd.Series(np.power(2.0, -total / len(model)))

    scored = scaled.withColumn("score", score(*FEATURES))
    share = min(sensitivity, 0.3)
    cut = scored.agg(F.percentile_approx("score", 1 - share, 10000).alias("c")).scalar()
    return scored.select("rule_id", "run_id", "score", (F.col("score") > cut).alias("is_anomaly"))
