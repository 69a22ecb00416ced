"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query writes its whole result to Spark's no-op sink. The better of two
runs counts, so that class loading and code generation are not measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tillwise.functions import checks  # noqa: E402
from tillwise.operators import anomaly, ingest, marts, quality  # noqa: E402
from tillwise.plans import registry  # noqa: E402
from tillwise.plans.ingestion import keyed  # noqa: E402
from tillwise.plans.quality import RULES, dq  # noqa: E402
from tillwise.plans.standins import Tables  # noqa: E402
from tillwise.plans.validation import pos_records  # noqa: E402
from tillwise.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "agg_daily_sales", "agg_daily_sales_full", "agg_branch_performance", "agg_dashboard_kpis", "agg_revenue_trends",
    "agg_fact_customer_behavior", "agg_inventory_movement", "agg_rule_set", "join_surrogate_keys", "join_fk_lookup",
    "win_recent_purchases", "win_brute_force", "ingest_dedup", "ingest_validate_split", "val_batch_summary", "log_report", "log_failed_login_burst",
    "sec_rate_limit", "cohort_retention", "ts_bucket_agg", "pii_scan_text", "pii_scan_table", "upd_inventory_depletion", "gdpr_access_report",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def ingest_to_mart(t):
    """Ids, first record per id, validation and daily totals of the valid rows."""
    fresh = ingest.deduplicate(keyed(t), ["event_id"]).select("source", F.to_date("created_at").alias("day"), "amount")
    good, _ = ingest.split(checks.validate(pos_records(t), "pos"))
    lines = good.select(
        F.lit("pos").alias("source"), F.left("sale_time", F.lit(10)).cast("date").alias("day"), F.col("total_amount").cast("decimal(18,2)").alias("amount")
    )
    return fresh.unionByName(lines).groupBy("source", "day").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))


def twenty_rules(t):
    """The ten rules twice, with other thresholds: one aggregation."""
    more = [dict(r, name=r["name"] + "_strict", threshold=(r["threshold"] or 0) / 2) for r in RULES]
    return quality.run_rules(dq(t), RULES + more, marts.max_of(t.lineitem, "l_shipdate"))


def ten_thousand_points(t):
    """A history of 10,000 runs of one rule, the size the baseline's limits are stated for."""
    return t.events.where("event_id < 10000").select(
        F.lit("one").alias("rule_id"), F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("finished_at"),
        F.col("value").cast("long").alias("violations_count"), F.lit(500).cast("long").alias("rows_scanned"), F.col("value").alias("duration_seconds"),
    )


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS), app="bench")
    t = Tables(spark, SF_DIR)
    catalogue = registry.spark_queries()
    jobs = {name: (lambda n=name: catalogue[n](spark, SF_DIR)) for name in HEADLINE}
    jobs["ingest_to_mart"] = lambda: ingest_to_mart(t)
    jobs["dq_twenty_rules"] = lambda: twenty_rules(t)
    points = ten_thousand_points(t)
    jobs["anom_zscore_10k"] = lambda: anomaly.zscore(points)
    jobs["anom_iqr_10k"] = lambda: anomaly.iqr(points)
    jobs["anom_isolation_forest_10k"] = lambda: anomaly.isolation_forest(points)
    times = {}
    for name, make in jobs.items():
        best = None
        for _ in range(2):
            start = time.perf_counter()
            run(make())
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    events, lines = t.events.count(), t.lineitem.count()
    rates = {
        "ingest_records_per_minute": round((events + lines) / times["ingest_to_mart"] * 60),
        "log_entries_per_second": round(events / times["log_report"]),
        "dq_rows_times_rules_per_second": round(lines * 20 / times["dq_twenty_rules"]),
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rates": rates,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
