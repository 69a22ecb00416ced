"""Business updates on tables and table upkeep."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwise.functions import prefix
from tillwise.session import checkpointed


def bulk_set(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """New values by key with old and new value; keys that are not in the table
    are reported as missing. ``changes`` has one row per key."""
    t = table.select(F.col(key).alias("_k"), F.col(column).alias("old_value"))
    c = changes.select(F.col(key).alias("_c"), F.col(column).alias("new_value"))
    return t.join(c, F.col("_k") == F.col("_c"), "full_outer").select(
        F.coalesce("_k", "_c").alias(key),
        "old_value",
        F.when(F.col("_k").isNotNull(), F.coalesce("new_value", "old_value")).alias("new_value"),
        F.when(F.col("_k").isNull(), "missing").when(F.col("_c").isNull(), "unchanged").otherwise("updated").alias("status"),
    )


BLOCK = 4096  # demands of a key that travel as one row


class Minima:
    """Tree of minima over ordered amounts: each node holds the least of its two."""

    def __init__(self, amounts: np.ndarray):
        size = 1 << max(0, (len(amounts) - 1).bit_length())
        leaves = np.full(size, np.inf if amounts.dtype.kind == "f" else np.iinfo(np.int64).max, amounts.dtype)
        leaves[: len(amounts)] = amounts
        self.levels = [leaves.tolist()]
        while len(leaves) > 1:
            leaves = np.minimum(leaves[0::2], leaves[1::2])
            self.levels.append(leaves.tolist())
        self.size = len(amounts)

    def first(self, at: int, left) -> int:
        """First place from ``at`` on whose amount is at most ``left``; the number of amounts if there is none."""
        level, node = 0, at
        while level < len(self.levels) and node < len(self.levels[level]):
            if self.levels[level][node] <= left:
                while level:  # down to the first that fits
                    level, node = level - 1, 2 * node
                    if self.levels[level][node] > left:
                        node += 1
                return min(node, self.size)
            # Up while this is a right child, then over to the right neighbour.
            while node % 2 and level < len(self.levels):
                level, node = level + 1, node // 2
            node += 1
        return self.size


def taken(amounts: np.ndarray, left) -> tuple:
    """Number and sum of the amounts that ``left`` covers, one after the other."""
    total = amounts.sum()
    if total <= left:
        return len(amounts), total
    tree, at, number, rest = Minima(amounts), 0, 0, left
    values = tree.levels[0]
    while (at := tree.first(at, rest)) < tree.size:
        rest -= values[at]
        number, at = number + 1, at + 1
    return number, left - rest


def _blocks(kind: str):
    """Consecutive demands of a (key, chunk) as one row: count, least, bytes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = batch.column(prefix.CHUNK).to_numpy()
            key = batch.column("_key").dictionary_encode().indices.to_numpy()
            edge = np.flatnonzero((chunk[1:] != chunk[:-1]) | (key[1:] != key[:-1])) + 1
            amounts = batch.column("_amount").to_numpy()
            cuts = [c for low, high in zip([0, *edge.tolist()], [*edge.tolist(), len(chunk)], strict=True) for c in range(low, high, BLOCK)]
            parts = [amounts[low:high] for low, high in zip(cuts, [*cuts[1:], len(chunk)], strict=True)]
            columns = [batch.column(c).take(pa.array(cuts)) for c in (prefix.CHUNK, "_key", "_place", "_left")]
            made = [pa.array([p.min() for p in parts], batch.column("_amount").type), pa.array([p.tobytes() for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[prefix.CHUNK, "_key", "_place", "_left", "_least", "_bytes"])

    return run


def _walked(dtype: str):
    """Amount and number taken from each key, block after block; a block whose
    least amount is above the rest is passed over unread."""

    def run(batches):
        key, left, start, number, out = object(), None, None, 0, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_key", "_left", "_least", "_bytes")]
            for k, begin, least, raw in zip(*columns, strict=True):
                if k != key:
                    if start is not None:
                        out.append((key, start - left, number))
                    key, left, start, number = k, begin, begin, 0
                if least <= left:
                    n, total = taken(np.frombuffer(raw, dtype), left)
                    left, number = left - total, number + n
        if start is not None:
            out.append((key, start - left, number))
        kind = pa.float64() if dtype == "float64" else pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], kind), pa.array([o[2] for o in out], pa.int64())], names=["_key", "_taken", "_number"])

    return run


def _units(c: Column, kind: str) -> tuple[Column, str]:
    """An amount as a whole number of its smallest unit (a decimal), or as it is."""
    if kind.startswith("decimal"):
        scale = int(kind.rstrip(")").split(",")[1])
        return (c * F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast("bigint"), "bigint"
    return (c.cast("double"), "double") if kind in ("double", "float") else (c.cast("bigint"), "bigint")


def deplete(balances: DataFrame, demand: DataFrame, key: str, balance: str, amount: str, order: list[str]) -> DataFrame:
    """Subtract amounts in order, each only if the balance covers it.

    Demands are cut into chunks along key and order. Chunks that the balance
    covers as a whole are taken by their sums; what is left behind them bounds
    all later demands, so larger ones are refused at once. The others travel in
    blocks of ``BLOCK`` amounts with their least one, in order: a block whose
    least amount is above the rest is passed over, in the others a tree of
    minima finds the next demand that fits. No key is gathered in one value, and
    memory is one block. ``balances`` has one row per key; demands that are null
    or not positive are no requests.

    Decimals are counted in their smallest unit and have to fit 64 bits.
    """
    held = dict(balances.dtypes)[balance]
    asked_kind = dict(demand.dtypes)[amount]
    common = held if held.startswith("decimal") else asked_kind if asked_kind.startswith("decimal") else "double" if {"double", "float"} & {held, asked_kind} else "bigint"
    if held.startswith("decimal") and asked_kind.startswith("decimal"):
        scale = max(int(k.rstrip(")").split(",")[1]) for k in (held, asked_kind))
        common = f"decimal({18 + scale},{scale})"
    unit = lambda c: _units(c.cast(common), common)
    kind = unit(F.lit(0))[1]
    dtype = "float64" if kind == "double" else "int64"

    text = F.col(key).cast("string")
    live = demand.join(balances.select(key, balance), key).where(F.col(amount) > 0)
    asked = live.groupBy(key).agg(F.count("*").alias("requests"))
    fitting = live.where(F.col(amount) <= F.col(balance)).select(text.alias("_key"), unit(F.col(amount))[0].alias("_amount"), unit(F.col(balance))[0].alias("_left"), *order)
    parts = prefix.cut(fitting, ["_key", *order])
    sums = parts.groupBy("_key", prefix.CHUNK).agg(F.sum("_amount").alias("_sum"), F.count("*").alias("_n"), F.first("_left").alias("_left"))
    so_far = Window.partitionBy("_key").orderBy(prefix.CHUNK)
    chunks = sums.withColumn("_through", F.sum("_sum").over(so_far)).withColumn("_whole", F.col("_through") <= F.col("_left"))
    # Chunks covered as a whole, from the first on: their sums do the work.
    covered = chunks.where("_whole").groupBy("_key").agg(F.sum("_sum").alias("_gone"), F.sum("_n").alias("_many"))
    rest = parts.join(chunks.where("NOT _whole").select("_key", prefix.CHUNK), ["_key", prefix.CHUNK]).join(covered, "_key", "left")
    rest = rest.withColumn("_left", F.col("_left") - F.coalesce("_gone", F.lit(0))).where(F.col("_amount") <= F.col("_left"))
    rest = rest.sortWithinPartitions("_key", prefix.CHUNK, *order).select(prefix.CHUNK, "_key", F.monotonically_increasing_id().alias("_place"), "_left", "_amount")
    blocks = rest.mapInArrow(_blocks(kind), f"{prefix.CHUNK} int, _key string, _place bigint, _left {kind}, _least {kind}, _bytes binary")
    walked = blocks.repartition("_key").sortWithinPartitions("_key", prefix.CHUNK, "_place").mapInArrow(_walked(dtype), f"_key string, _taken {kind}, _number bigint")

    both = covered.join(walked, "_key", "full_outer")
    zero = F.lit(0).cast(kind)
    found = both.select(
        F.col("_key").alias("_found"),
        (F.coalesce("_gone", zero) + F.coalesce("_taken", zero)).alias("_total"),
        (F.coalesce("_many", F.lit(0)) + F.coalesce("_number", F.lit(0))).cast("bigint").alias("accepted"),
    )
    out = balances.join(asked, key, "left").join(found, text == F.col("_found"), "left")
    total = F.coalesce("_total", zero)
    if common.startswith("decimal"):
        scale = int(common.rstrip(")").split(",")[1])
        total = (total / F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast(common)
    return out.select(
        *[out[c] for c in balances.columns],
        (F.col(balance) - total).cast(held).alias("remaining"),
        F.coalesce("accepted", F.lit(0).cast("bigint")).alias("accepted"),
        (F.coalesce("requests", F.lit(0)) - F.coalesce("accepted", F.lit(0))).alias("refused"),
    )


def inventory_status(stock: Column, reorder: Column, expiry: Column, today: Column) -> Column:
    return F.when(expiry < today, "expired").when(stock <= reorder, "low_stock").otherwise("in_stock")


def audit_snapshot(events: DataFrame, users: DataFrame) -> DataFrame:
    """Copy user attributes into the event, add an event key and the end of retention."""
    j = events.join(users, "user_id", "left")
    return j.withColumns(
        {
            "audit_key": F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "action", F.col("user_id").cast("string")), 256),
            "retain_until": F.add_months(F.to_date("ts"), 84),
        }
    )


def analyze(spark: SparkSession, table: str) -> DataFrame:
    """Compute table and column statistics and show them per column."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
    rows = None
    for c in spark.table(table).columns:
        info = spark.sql(f"DESCRIBE EXTENDED {table} {c}")
        one = info.agg(
            *[F.max(F.when(F.col("info_name") == k, F.col("info_value"))).alias(k) for k in ("min", "max", "num_nulls", "distinct_count")]
        ).withColumn("column", F.lit(c))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def compact(spark: SparkSession, path: str, partition: str, rows_per_file: int = 5_000_000) -> None:
    """Rewrite a partitioned table so that a partition holds few files. Rows of
    a partition are spread over as many writers as its size needs, by a hash of
    the row, so that a repeated task sends every row to the same place."""
    df = checkpointed(spark.read.parquet(path))
    sizes = df.groupBy(partition).agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))
    spread = df.join(sizes, partition).withColumn("_slot", F.pmod(F.xxhash64(*df.columns), F.col("_files")))
    spread.repartition(partition, "_slot").drop("_files", "_slot").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(partition).parquet(path)


def file_counts(spark: SparkSession, path: str, partition: str) -> DataFrame:
    files = spark.read.parquet(path).select(partition, F.col("_metadata.file_path").alias("f"))
    return files.groupBy(partition).agg(F.count("*").alias("rows"), F.count_distinct("f").alias("files"))
