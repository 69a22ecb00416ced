"""Index of ids that have been seen, in hash buckets with a Bloom filter each.

Ids are stored under ``ids/bucket=K/batch_id=B``, the filter of a bucket under
``filters/bucket=K``. A batch of new ids is hashed to buckets; it reads the
filters of these buckets, one file each, and the ids only of buckets in which a
filter hits. A bucket whose ids lie in more than ``MOST_PARTS`` parts is written
together, with a filter for its size, so neither the number of files a batch
opens nor the share of false hits grows with the history.

Filters are written before the ids they tell of, and ids carry the batch that
brought them: a batch that is repeated passes over its own ids and writes the
same ones, and a filter that knows too many ids only costs a look.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.session import checkpointed

PROBES = 7
BITS_PER_ID = 10
LEAST_BITS = 1 << 13
MOST_PARTS = 8
FILTERS = "bucket int, bits binary"


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(ids, probes) places in a filter of that many bits."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def _size(ids: int) -> int:
    return max(LEAST_BITS, 1 << (ids * BITS_PER_ID - 1).bit_length())


def with_ids(bits: bytes | None, hashes: np.ndarray) -> bytes:
    """The filter that knows these ids as well."""
    flags = np.unpackbits(np.frombuffer(bits, np.uint8)) if bits else np.zeros(_size(len(hashes)), np.uint8)
    flags[_places(hashes, len(flags)).reshape(-1)] = 1
    return np.packbits(flags).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    flags = np.unpackbits(np.frombuffer(bits, np.uint8))
    return flags[_places(hashes, len(flags))].all(axis=1)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _paths(spark: SparkSession, root: str, buckets: list[int]) -> list[str]:
    """Folders of these buckets that exist."""
    there = {c for c in _children(spark, root) if c.startswith("bucket=")}
    return [f"{root}/bucket={b}" for b in buckets if f"bucket={b}" in there]


def _read(spark: SparkSession, root: str, schema: str, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*paths)


def _id_schema(kind: str) -> str:
    return f"id {kind}, bucket int, batch_id bigint"


def _probe(key: tuple, ids: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Ids of a bucket that its filter may hold."""
    if not len(ids) or not len(filters):
        return ids[:0][["id", "bucket"]]
    return ids[may_hold(filters["bits"].iloc[0], ids["h"].to_numpy(np.int64))][["id", "bucket"]]


def _extend(key: tuple, ids: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    bits = filters["bits"].iloc[0] if len(filters) else None
    return pd.DataFrame({"bucket": [key[0]], "bits": [with_ids(bits, ids["h"].to_numpy(np.int64))]})[: 1 if len(ids) else 0]


def _rebuilt(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "bits": [with_ids(None, pdf["h"].to_numpy(np.int64))]})


def claim(batch: DataFrame, key: str, root: str, batch_id: int, buckets: int) -> DataFrame:
    """Rows of the batch, one per id, whose id no earlier batch has brought; the
    index then knows them. Rows without an id are not kept."""
    spark = batch.sparkSession
    kind = dict(batch.dtypes)[key]
    ids_root, filters_root = f"{root}/ids", f"{root}/filters"
    h = F.xxhash64(key)
    rows = batch.where(F.col(key).isNotNull()).withColumn("_bucket", F.pmod(h, F.lit(buckets)).cast("int")).persist()
    try:
        ids = rows.select(F.col(key).alias("id"), F.col("_bucket").alias("bucket"), h.alias("h"))
        touched = sorted(r[0] for r in ids.select("bucket").distinct().collect())  # at most ``buckets``
        filters = _read(spark, filters_root, FILTERS, _paths(spark, filters_root, touched))
        grouped, known = ids.groupBy("bucket"), filters.groupBy("bucket")
        hits = grouped.cogroup(known).applyInPandas(_probe, f"id {kind}, bucket int")
        opened = sorted(r[0] for r in hits.select("bucket").distinct().collect())
        stored = _read(spark, ids_root, _id_schema(kind), _paths(spark, ids_root, opened)).where(F.col("batch_id") != batch_id)
        # Written apart: what follows replaces files that these rows were read from.
        fresh = checkpointed(rows.join(stored.select(F.col("id").alias(key)), key, "left_anti").drop("_bucket"))
        new = fresh.select(F.col(key).alias("id"), F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"), h.alias("h"))
        _replace(checkpointed(new.groupBy("bucket").cogroup(known).applyInPandas(_extend, FILTERS)), filters_root, ["bucket"])
        _replace(new.select("id", "bucket", F.lit(batch_id).cast("bigint").alias("batch_id")).repartition("bucket"), ids_root, ["bucket", "batch_id"])
        _compact(spark, root, kind, touched, batch_id)
        return fresh
    finally:
        rows.unpersist()


def _replace(df: DataFrame, root: str, partitions: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(root)


def _compact(spark: SparkSession, root: str, kind: str, touched: list[int], batch_id: int) -> None:
    """Write the parts of a bucket together where there are too many, this
    batch's own part left out: a repetition has to find it apart."""
    ids_root = f"{root}/ids"
    old: dict[int, list[int]] = {}
    for b in touched:
        parts = sorted(int(c.split("=")[1]) for c in _children(spark, f"{ids_root}/bucket={b}") if c.startswith("batch_id="))
        before = [p for p in parts if p < batch_id]
        if len(parts) > MOST_PARTS and len(before) > 1:
            old[b] = before
    if not old:
        return
    part = lambda b, p: f"{ids_root}/bucket={b}/batch_id={p}"
    stored = _read(spark, ids_root, _id_schema(kind), [f"{ids_root}/bucket={b}" for b in sorted(old)])
    everything = checkpointed(stored.select("id", "bucket", "batch_id"))
    newest = F.create_map(*[F.lit(v) for b, parts in sorted(old.items()) for v in (b, parts[-1])])[F.col("bucket")]
    merged = everything.where(F.col("batch_id") < batch_id).select("id", "bucket").distinct().withColumn("batch_id", newest.cast("bigint"))
    _replace(merged.repartition("bucket"), ids_root, ["bucket", "batch_id"])
    for b, parts in old.items():
        for p in parts[:-1]:  # what they held is in the newest part now
            where, fs = _hadoop(spark, part(b, p))
            fs.delete(where, True)
    hashed = everything.select("bucket", F.xxhash64("id").alias("h")).distinct()
    _replace(hashed.groupBy("bucket").applyInPandas(_rebuilt, FILTERS), f"{root}/filters", ["bucket"])
