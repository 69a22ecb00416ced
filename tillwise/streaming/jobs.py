"""Streaming forms of the detectors and of the ingest.

Every job equals its batch form on closed windows. Log windows wait 10 minutes
for late rows; later rows are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tillwise.functions import checks
from tillwise.operators import logs
from tillwise.session import scratch_path
from tillwise.sources import sinks
from tillwise.streaming import idindex

DELAY = "10 minutes"


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def failed_login_burst(stream: DataFrame, minutes: int = 5, least: int = 5, delay: str = DELAY) -> DataFrame:
    w = F.window("ts", f"{minutes} minutes")
    return (
        logs.failed_logins(stream.withWatermark("ts", delay))
        .groupBy("user_id", w.alias("w"))
        .agg(F.count("*").alias("count"))
        .where(F.col("count") >= least)
        .select("user_id", "count", F.col("w.start").alias("first_seen"), F.col("w.end").alias("last_seen"))
    )


def brute_force(stream: DataFrame, minutes: int = 15, slide: int = 1, least: int = 5, delay: str = DELAY) -> DataFrame:
    w = F.window("ts", f"{minutes} minutes", f"{slide} minutes")
    failed = stream.where(F.col("action").isin("LOGIN_FAILED", "MFA_FAILED") & ~F.col("success"))
    return (
        failed.withWatermark("ts", delay)
        .groupBy("ip", w.alias("w"))
        .agg(F.count("*").alias("failed_attempts"))
        .where(F.col("failed_attempts") >= least)
        .select("ip", "failed_attempts", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))
    )


def rate_sessions(stream: DataFrame, key: str, gap: str, limit: int, delay: str = DELAY) -> DataFrame:
    s = F.session_window("ts", gap)
    return (
        stream.withWatermark("ts", delay)
        .groupBy(key, s.alias("w"))
        .agg(F.count("*").alias("requests"))
        .where(F.col("requests") > limit)
        .select(key, "requests", F.col("w.start").alias("started"), F.col("w.end").alias("closed"))
    )


def dedup(stream: DataFrame, path: str, key: str = "ingest_id", buckets: int = 64) -> None:
    """First arrival per id into a table. Ids are compared with all that came
    before, however old, by an index of ids in hash buckets (``idindex``): a
    batch reads the filters of its buckets, and ids only of buckets whose filter
    hits. A repeated batch replaces its own rows only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = idindex.claim(batch.dropDuplicates([key]), key, f"{path.rstrip('/')}-ids", batch_id, buckets)
        mode = "dynamic" if written(batch.sparkSession, path) else "static"
        fresh.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("batch_id").parquet(path)

    _each_batch(stream, write, "dedup")


def written(spark, path: str) -> bool:
    """Whether a table has been written here to the end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


LOCK_OUT = "user_id long, event_id long, outcome string, failures int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LockoutProcessor(StatefulProcessor):
    """Attempts of a user, rows as they come in a batch by time and event.

    State: failures and end of the lock, in microseconds. A timer in event time
    ends it: with a lock, when that is over and nothing keeps the failures (they
    stand until an accepted attempt); open failures without a further attempt
    are forgotten ``forget`` after the last one."""

    def __init__(self, limit: int, hold: int, forget: int):
        self.limit, self.hold, self.forget = limit, hold, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lock", "fails int, locked_until bigint, keep_until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.state.get() if self.state.exists() else (0, 0, 0)
        fails, until, keep = before
        # Rows of one batch and user, ordered by time: a heap of their times and outcomes only.
        for at, event_id, ok in sorted((r["at"], r["event_id"], r["ok"]) for r in rows):
            if keep and at >= keep:
                fails, until = 0, 0
            if at < until:
                outcome = "refused"
            elif ok:
                fails, outcome = 0, "accepted"
            else:
                fails += 1
                outcome = "failed"
                if fails >= self.limit:
                    until, outcome = at + self.hold, "locked"
            if outcome != "refused":
                keep = max(at, until) + self.forget if fails else 0
            yield Row(user_id=key[0], event_id=event_id, outcome=outcome, failures=fails)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if fails:
            self.state.update((fails, until, keep))
            self.handle.registerTimer(-(-keep // 1000))
        elif self.state.exists():
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def lockout(stream: DataFrame, limit: int = 5, minutes: int = 30, delay: str = DELAY, forget_days: int = 365) -> DataFrame:
    """Outcome of every login attempt ``(user_id, event_id, ts, ok)``: accepted,
    failed, locked (this failure locks the account) or refused (while locked).

    Open failures are forgotten ``forget_days`` after the last attempt that was
    not refused, so the state of every user ends. Needs the RocksDB state store."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    attempts = stream.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    processor = LockoutProcessor(limit, minutes * 60_000_000, forget_days * 86_400_000_000)
    return attempts.groupBy("user_id").transformWithState(processor, LOCK_OUT, "Append", "EventTime")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run over all available input into a Parquet table and read it back."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _each_batch(stream: DataFrame, handler, name: str, mode: str = "append") -> None:
    state = scratch_path(stream.sparkSession, f"{name}-state")
    q = stream.writeStream.foreachBatch(handler).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def daily_sales(stream: DataFrame, path: str, keys: list[str], aggregates: dict[str, Column], partition: str) -> None:
    """Running aggregate kept in a partitioned table: changed groups of a batch
    replace their rows, so a repeated batch changes nothing."""
    totals = stream.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        table = batch.withColumn("updated_at", F.lit(None).cast("timestamp"))
        if not written(spark, path):  # the first batch, or its repetition
            table.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(partition).parquet(path)
            return
        sinks.upsert_table(spark, path, table.drop("updated_at"), keys, list(aggregates), F.current_timestamp(), partition)

    _each_batch(totals, write, "daily", "update")


def validate_split(stream: DataFrame, source_name: str, valid_path: str, invalid_path: str) -> None:
    """Valid and invalid rows of every batch into their own tables; the batch id
    partitions both, so a repeated batch overwrites itself. Rows are judged once and
    kept for both; a large batch is dealt in parts of even size before, as what is
    kept of a part of a file is many times its bytes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = checks.validate(batch.hint("rebalance"), source_name).withColumn("batch_id", F.lit(batch_id))
        checked.persist()
        try:
            for keep, path in ((F.col("is_valid"), valid_path), (~F.col("is_valid"), invalid_path)):
                checked.where(keep).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        finally:
            checked.unpersist()

    _each_batch(stream, write, "split")
