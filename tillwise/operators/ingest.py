"""Ingest: ids, de-duplication, batches, split, enrichment, run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillwise.functions import prefix
from tillwise.functions.columns import percent

# Fields that identify a record, by source family.
KEY_FIELDS = {
    "pos": ("order_id", "transaction_id", "receipt_number"),
    "api_sales": ("order_id", "transaction_id", "receipt_number"),
    "inventory": ("product_id", "location_id", "timestamp"),
    "staff": ("employee_id", "shift_id", "date"),
}


def ingest_id(source: Column, columns: list[str], batch: Column, index: Column) -> Column:
    """``{source}_{field}_{value}`` of the first non-empty key field, else
    ``{source}_{batch}_{index}``."""
    picked = []
    for family, fields in KEY_FIELDS.items():
        for f in fields:
            if f in columns:
                v = F.col(f).cast("string")
                picked.append(F.when((source == family) & (F.trim(v) != ""), F.concat_ws("_", source, F.lit(f), v)))
    fallback = F.concat_ws("_", source, batch.cast("string"), index.cast("string"))
    return F.coalesce(*picked, fallback)


def deduplicate(incoming: DataFrame, order: list[str], stored: DataFrame | None = None, key: str = "ingest_id") -> DataFrame:
    """First record per id, ids already stored left out. ``min_by`` keeps one
    row per id before the shuffle, so a repeated id is no hot group."""
    rest = [c for c in incoming.columns if c != key]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")
    return first if stored is None else first.join(stored.select(key), key, "left_anti")


def batches(df: DataFrame, order: list[str], size: int = 1000, job: str = "job", run: str = "run") -> DataFrame:
    """Consecutive batches of ``size`` rows. Rows are numbered inside
    chunks and chunk totals accumulated, so no task sees the whole input."""
    numbered = prefix.running(df, [], order, row_number="_rn")
    k = F.floor((F.col("_rn") - 1) / size)
    return numbered.withColumns(
        {"batch_no": k, "batch_id": F.concat_ws("_", F.lit(job), F.lit(run), k.cast("string"))}
    ).drop("_rn")


def state(is_valid: Column) -> Column:
    """Where a record goes; a job that writes both sides partitions by it and
    checks its input once."""
    return F.when(is_valid, "valid").otherwise("invalid")


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and the quarantine with its error list."""
    return checked.where("is_valid"), checked.where(~F.col("is_valid"))


def enrich(payload: Column, enriched: Column) -> Column:
    """Union of two string maps; the enriched value wins."""
    kept = F.map_filter(payload, lambda k, v: ~F.map_contains_key(enriched, k))
    return F.map_concat(kept, enriched)


def by_source(df: DataFrame, families: dict[str, list[str]], aggregates: list[Column]) -> DataFrame:
    """Aggregate the rows of every known source family in one pass."""
    family = None
    for name, sources in families.items():
        hit = F.col("source").isin(*sources)
        family = F.when(hit, name) if family is None else family.when(hit, name)
    return df.withColumn("family", family).where(F.col("family").isNotNull()).groupBy("family").agg(*aggregates)


def error_rate_alerts(results: DataFrame, keys: list[str], threshold: float = 10.0) -> DataFrame:
    """High alert for every group whose error share is above the threshold."""
    rate = percent(F.col("errors"), F.col("total"), 0)
    return (
        results.groupBy(*keys)
        .agg(F.count("*").alias("total"), F.count_if(F.col("state") == "error").alias("errors"))
        .withColumn("error_rate", rate)
        .where(F.col("error_rate") > threshold)
        .withColumn("severity", F.lit("high"))
    )


def run_metrics(rows: DataFrame, run: Column) -> DataFrame:
    """Processed, failed, duration and success rate per run."""
    n, bad = F.col("rows_processed"), F.col("rows_failed")
    return rows.groupBy(run.alias("run")).agg(
        F.count("*").alias("rows_processed"),
        F.count_if(F.col("state") == "error").alias("rows_failed"),
        (F.unix_timestamp(F.max("created_at")) - F.unix_timestamp(F.min("created_at"))).alias("duration_seconds"),
    ).withColumn("success_rate", percent(n - bad, n, 0))


class Lineage:
    """Rows per stage of a run, counted while the run writes its result: each
    stage is observed where it stands in the plan, so nothing is read twice.

    Spark counts with accumulators: the tasks of a stage that has to run again,
    because an executor was lost with its shuffle files, are counted again."""

    def __init__(self) -> None:
        self.stages: list[tuple[str, str, str, Observation]] = []

    def stage(self, df: DataFrame, event: str, source: str, target: str, counted: Column | None = None) -> DataFrame:
        """The rows, observed; ``counted``: the rows that the stage affects (all)."""
        seen = Observation(f"{event}-{len(self.stages)}")
        self.stages.append((event, source, target, seen))
        return df.observe(seen, F.count_if(counted if counted is not None else F.lit(True)).alias("n"))

    def rows(self, spark: SparkSession) -> DataFrame:
        """One row per stage, after the run has been written."""
        found = [(event, source, target, seen.get["n"]) for event, source, target, seen in self.stages]
        return spark.createDataFrame(found, "event_type string, source_table string, target_table string, affected_rows bigint")


# Days to keep and the state that allows deletion.
RETENTION = {
    "raw_events": (365, "processed"),
    "errors": (90, "resolved"),
    "runs": (30, "archived"),
    "alerts": (7, "resolved"),
    "warehouse_raw": (90, None),
    "dq": (90, None),
}


def expired(kind: str, ts: str, state: str, as_of: Column, days: int | None = None) -> Column:
    keep, needed = RETENTION[kind]
    old = F.col(ts) < as_of - F.expr(f"INTERVAL {days or keep} DAYS")
    return old & (F.col(state) == needed) if needed else old


def retention(df: DataFrame, is_expired: Column) -> tuple[DataFrame, DataFrame]:
    """Kept rows and the number of dropped ones."""
    flag = F.coalesce(is_expired, F.lit(False))
    return df.where(~flag), df.agg(F.count_if(flag).alias("dropped"), F.count_if(~flag).alias("kept"))
