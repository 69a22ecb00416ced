"""Embedding near-duplicates by cross-polytope hashing.

A vector, scaled to length one and padded to a power of two, is turned by three
rounds of random signs and a fast Hadamard transform; its hash is the signed
axis it then lies closest to. ``hashes`` such values name a bucket of a table.
Multiprobe: a vector has a home bucket per table and looks into the
``probes`` buckets that follow when the least decided axes are exchanged; two
vectors are a candidate pair where one looks into the home of the other.

1. Vectors equal in every component are one class; the smallest id stands for it.
2. Buckets with a home and another member are dealt in blocks of at most
   ``block`` members, a task for each pair of blocks.
3. A task takes exact cosines of its block pair. A pair counts in the first
   table (and there in one bucket) where it meets, which is told from the
   members' own hashes, so that no pairs have to be gathered and made distinct.
   It returns a number of links per member and a spanning forest of its links.
4. Links are summed per class, components come from the forests
   (``components``), and both are brought back to all vectors.

Null vectors, zero vectors and vectors with null or non-finite components link
with nothing, and so do rows without an id. Vectors of different length never
link. Repeated rows of an id count as one vector, each with its own result row.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm import text as tx
from tillwise.llm.components import components
from tillwise.llm.minhash import forest
from tillwise.session import scratch_path


@dataclass(frozen=True)
class Params:
    cosine: float = 0.95
    tables: int = 8
    hashes: int = 3
    probes: int = 3  # buckets looked into besides the home
    block: int = 512


@cache
def _signs(dim: int, tables: int, hashes: int) -> np.ndarray:
    return np.random.default_rng(dim).choice([-1.0, 1.0], (tables * hashes, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the last axis (a power of two)."""
    step = 1
    while step < x.shape[-1]:
        y = x.reshape(*x.shape[:-1], -1, 2, step)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x / np.sqrt(x.shape[-1])


def buckets(unit: np.ndarray, p: Params) -> np.ndarray:
    """(vectors, tables, 1 + probes) bucket keys, the home first."""
    n, d = unit.shape
    dim = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, dim))
    padded[:, :d] = unit
    keys = np.zeros((n, p.tables, 1 + p.probes), np.int64)
    # Per hash the axes by falling weight, and what choosing a later one costs.
    kept = min(3, dim)
    for t in range(p.tables):
        axes = np.empty((n, p.hashes, kept), np.int64)
        cost = np.empty((n, p.hashes, kept))
        for h in range(p.hashes):
            y = padded
            for signs in _signs(dim, p.tables, p.hashes)[t * p.hashes + h]:
                y = hadamard(y * signs)
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :kept]
            weight = np.take_along_axis(size, top, 1)
            axes[:, h] = 2 * top + (np.take_along_axis(y, top, 1) > 0)
            cost[:, h] = (weight[:, :1] - weight) ** 2
        # All ways to take one of the best axes in each hash, cheapest first.
        ways = np.stack(np.meshgrid(*[np.arange(kept)] * p.hashes, indexing="ij"), -1).reshape(-1, p.hashes)
        price = sum(cost[:, h][:, ways[:, h]] for h in range(p.hashes))
        best = np.argsort(price, axis=1, kind="stable")[:, : 1 + p.probes]
        key = np.full(best.shape, t, np.int64)
        for h in range(p.hashes):
            key = key * (2 * dim + 1) + np.take_along_axis(axes[:, h], ways[best, h], 1)
        keys[:, t, : key.shape[1]] = key
        keys[:, t, key.shape[1] :] = key[:, :1]
    return keys


def unit_rows(flat: np.ndarray, rows: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(rows, -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, no null or non-finite component, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def _homes(p: Params):
    """Member rows: each class under its buckets."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                dims = part.column("dim").to_numpy()
                for dim in np.unique(dims):
                    rows = part.filter(pa.array(dims == dim))
                    keys = buckets(unit_rows(rows.column("vector").flatten().to_numpy(), rows.num_rows), p)
                    reps = rows.column("rep").to_numpy()
                    n, tables, width = keys.shape
                    home = np.zeros(keys.shape, bool)
                    home[:, :, 0] = True
                    first = np.ones(keys.shape, bool)  # a bucket once per vector
                    for k in range(1, width):
                        first[:, :, k] = (keys[:, :, :k] != keys[:, :, k : k + 1]).all(2)
                    pick = first.reshape(-1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(reps, tables * width)[pick]),
                            pa.array(np.full(int(pick.sum()), dim, np.int32)),
                            pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), width), n)[pick]),
                            pa.array(keys.reshape(-1)[pick]),
                            pa.array(home.reshape(-1)[pick]),
                        ],
                        names=["rep", "dim", "table", "bucket", "home"],
                    )

    return run


SLOT = ["dim", "table", "bucket", "i", "j"]


def _meets(keys: np.ndarray, a: np.ndarray, b: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether b looks into a's home, and a into b's, in table t."""
    return (keys[b, t] == keys[a, t, :1]).any(1), (keys[a, t] == keys[b, t, :1]).any(1)


def _links(p: Params):
    def run(batches):
        for slot in tx.groups(batches, SLOT):
            reps, weight = slot.column("rep").to_numpy(), slot.column("n").to_numpy()
            side, home = slot.column("side").to_numpy(), slot.column("home").to_numpy(zero_copy_only=False)
            bucket, table = slot.column("bucket")[0].as_py(), slot.column("table")[0].as_py()
            same = slot.column("i")[0].as_py() == slot.column("j")[0].as_py()
            left = np.arange(len(reps)) if same else np.flatnonzero(side == 0)
            right = left if same else np.flatnonzero(side == 1)
            if len(reps) < 2 or not len(left) or not len(right):
                continue
            unit = unit_rows(slot.column("vector").combine_chunks().flatten().to_numpy(), len(reps))
            near = unit[left] @ unit[right].T >= p.cosine
            near &= home[left][:, None] | home[right][None, :]
            if same:
                near = np.triu(near, 1)
            a, b = np.nonzero(near)
            a, b = left[a], right[b]
            if not len(a):
                continue
            used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            keys = buckets(unit[used], p)
            x, y = place[: len(a)], place[len(a) :]
            new = np.ones(len(a), bool)
            for t in range(table):
                new &= ~np.logical_or(*_meets(keys, x, y, t))
            # In this table two homes may both bring the pair together; then
            # the home of the smaller id counts.
            into_x, into_y = _meets(keys, x, y, table)
            first = np.where(reps[a] < reps[b], into_x, into_y)
            smaller = np.where(reps[a] < reps[b], keys[x, table, 0], keys[y, table, 0])
            larger = np.where(reps[a] < reps[b], keys[y, table, 0], keys[x, table, 0])
            new &= bucket == np.where(first, smaller, larger)
            a, b = a[new], b[new]
            if not len(a):
                continue
            count = np.bincount(a, weight[b], len(reps)) + np.bincount(b, weight[a], len(reps))
            hit = np.flatnonzero(count)
            found = np.zeros((len(reps), len(reps)), bool)
            found[a, b] = True
            every = np.arange(len(reps))
            edges = np.array(forest(found, every, every, len(reps))).reshape(-1, 2)
            none = np.zeros(len(edges), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([reps[hit], reps[edges[:, 0]]])),
                    pa.array(np.concatenate([reps[hit], reps[edges[:, 1]]])),
                    pa.array(np.concatenate([count[hit].astype(np.int64), none])),
                ],
                names=["u", "v", "links"],
            )

    return run


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", params: Params | None = None) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly),
    component_id (smallest id reachable by links, itself included), kept."""
    p = params or Params()
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("vector"))
    good = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    path = scratch_path(spark, "vector-classes")
    good.groupBy("vector").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n")).withColumn("dim", F.size("vector")).write.parquet(path)
    classes = spark.read.parquet(path)

    path = scratch_path(spark, "vector-buckets")
    classes.select("rep", "dim", "vector").mapInArrow(_homes(p), "rep bigint, dim int, table int, bucket bigint, home boolean").write.parquet(path)
    members = spark.read.parquet(path)
    key = ["dim", "table", "bucket"]
    sizes = members.groupBy(*key).agg(F.count("*").alias("size"), F.max("home").alias("any_home")).where("size > 1 AND any_home").drop("any_home")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (
        members.join(sizes, key)
        .withColumn("blocks", F.ceil(F.col("size") / F.lit(p.block)).cast("int"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") == F.col("i"), 0).otherwise(1))
        .select("rep", *SLOT, "side", "home")
        .join(classes.select("rep", "n", "vector"), "rep")
    )
    path = scratch_path(spark, "vector-links")
    dealt.repartition(*SLOT).sortWithinPartitions(*SLOT).mapInArrow(_links(p), "u bigint, v bigint, links bigint").write.parquet(path)
    found = spark.read.parquet(path)
    linked = found.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(found.where("u <> v").select("u", "v")).withColumnRenamed("node", "rep")

    known = classes.join(linked, "rep", "left").join(parts, "rep", "left").select(
        F.col("vector").alias("class_vector"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    ours = rows.withColumn("usable", F.col("id").isNotNull() & usable(F.col("vector")))
    return ours.join(known, F.col("usable") & (F.col("vector") == F.col("class_vector")), "left").select(
        F.col("id").alias(id_column),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(False)).alias("kept"),
    )
