"""Detectors on security logs and audit trails (batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import prefix
from tillwise.functions.columns import any_of
from tillwise.functions.crypto import canonical_json, hmac_sha256
from tillwise.operators.windows import top_per_key



def failed_logins(log: DataFrame) -> DataFrame:
    return log.where((F.col("action") == "login") & (F.col("status") >= 400) & F.col("ts").isNotNull())


def failed_login_burst(log: DataFrame, minutes: int = 5, least: int = 5) -> DataFrame:
    """Users with many failures inside one aligned bucket."""
    w = F.window("ts", f"{minutes} minutes")
    return (
        failed_logins(log)
        .groupBy("user_id", w.alias("w"))
        .agg(F.count("*").alias("count"))
        .where(F.col("count") >= least)
        .select("user_id", "count", F.col("w.start").alias("first_seen"), F.col("w.end").alias("last_seen"))
    )


def burst_entries(log: DataFrame, bursts: DataFrame, minutes: int = 5) -> DataFrame:
    """The entries behind the bursts, as rows."""
    start = F.window("ts", f"{minutes} minutes").start
    return failed_logins(log).withColumn("first_seen", start).join(bursts.select("user_id", "first_seen"), ["user_id", "first_seen"], "left_semi")


def _spans(entries: DataFrame, key: str) -> DataFrame:
    return entries.groupBy(key).agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def is_export() -> Column:
    return any_of([F.lower(c).contains("export") for c in ("action", "endpoint", "message")])


def export_spike(log: DataFrame, more_than: int = 10) -> DataFrame:
    return _spans(log.where(is_export()), "user_id").where(F.col("count") > more_than)


def first_entries(log: DataFrame, keys: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First n entries of each flagged key, as rows; limited before the shuffle."""
    flagged = log.join(keys.select(key), key, "left_semi")
    return top_per_key(flagged, [key], [F.asc("ts"), F.asc("event_id")], n, "position")


def seconds(a: str = "first_seen", b: str = "last_seen") -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def suspicious_api(log: DataFrame, more_than: int = 100, within_minutes: int = 60) -> DataFrame:
    spans = _spans(log.where(F.col("endpoint") != ""), "user_id")
    return spans.where((F.col("count") > more_than) & (seconds() < within_minutes * 60))


def ip_many_users(log: DataFrame, more_than: int = 5) -> DataFrame:
    """Addresses used by many users. Entries are combined per address and user
    first, so a busy address is a short group."""
    per_user = log.where((F.col("ip") != "") & (F.col("user_id") != "")).groupBy("ip", "user_id").agg(
        F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")
    )
    return per_user.groupBy("ip").agg(
        F.count("*").alias("users"), F.sum("n").alias("count"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen")
    ).where(F.col("users") > more_than)


def ip_users(log: DataFrame, flagged: DataFrame) -> DataFrame:
    """The users of every flagged address, one row each."""
    pairs = log.select("ip", "user_id").distinct()
    return pairs.join(flagged, "ip")


def user_spans(log: DataFrame) -> DataFrame:
    """Export and request counts and spans per user from one aggregation."""
    named = {"export": is_export(), "api": F.col("endpoint") != ""}
    aggs = []
    for name, hit in named.items():
        ts = F.when(hit, F.col("ts"))
        aggs += [F.count_if(hit).alias(f"{name}_count"), F.min(ts).alias(f"{name}_first"), F.max(ts).alias(f"{name}_last")]
    per_user = log.groupBy("user_id").agg(*aggs)
    rows = [
        F.struct(F.lit(n).alias("kind"), F.col(f"{n}_count").alias("count"), F.col(f"{n}_first").alias("first_seen"), F.col(f"{n}_last").alias("last_seen"))
        for n in named
    ]
    return per_user.select("user_id", F.inline(F.array(*rows)))


def report(log: DataFrame, exports: int = 10, requests: int = 100, minutes: int = 60) -> DataFrame:
    """Findings of all four detectors with a description. Export spikes and
    request floods share one aggregation per user."""
    def shaped(df, kind, description, span):
        return df.select(kind.alias("type"), description.alias("description"), F.col("count"), span.alias("time_window"), "first_seen", "last_seen")

    hours = F.format_string("%.1f hours", seconds() / 3600)
    length = F.format_string("%.1f minutes", seconds() / 60)
    many = F.col("kind") == "export"
    spans = user_spans(log).where(
        (many & (F.col("count") > exports)) | (~many & (F.col("count") > requests) & (seconds() < minutes * 60))
    )
    said = F.when(many, F.format_string("User %s performed %d data exports", "user_id", "count")).otherwise(
        F.format_string("User %s made %d API requests in %.1f minutes", "user_id", "count", seconds() / 60)
    )
    parts = [
        shaped(failed_login_burst(log), F.lit("failed_login_burst"), F.format_string("User %s had %d failed login attempts in 5 minutes", "user_id", "count"), F.lit("5 minutes")),
        shaped(spans, F.when(many, "data_export_spike").otherwise("suspicious_api_access"), said, F.when(many, hours).otherwise(length)),
        shaped(ip_many_users(log), F.lit("ip_multiple_users"), F.format_string("IP %s accessed by %d different users", "ip", "users"), hours),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stats(log: DataFrame) -> DataFrame:
    """Entries by level and by status class in one pass."""
    status = F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx"))
    flat = log.select("level", status.alias("status_class"))
    sets = flat.groupingSets([[F.col("level")], [F.col("status_class")]], F.col("level"), F.col("status_class")).agg(
        F.count("*").alias("n"), F.grouping_id(F.col("level"), F.col("status_class")).alias("gid")
    )
    return sets.select(F.when(F.col("gid") == 1, "level").otherwise("status").alias("section"), F.coalesce("level", "status_class").alias("item"), "n")


def alerts(events: DataFrame) -> DataFrame:
    """One row per alert an audit event raises."""
    raised = F.array_compact(
        F.array(
            F.when(F.col("severity") == "CRITICAL", F.lit("CRITICAL_SECURITY_EVENT")),
            F.when(F.col("action").isin("PII_ACCESS", "UNAUTHORIZED_ACCESS") & ~F.col("success"), F.lit("DATA_ACCESS_VIOLATION")),
            F.when(F.col("action").isin("AUDIT_TAMPERING", "SECURITY_CONFIG_CHANGED"), F.lit("SYSTEM_INTEGRITY_VIOLATION")),
        )
    )
    return events.withColumn("alert_type", F.explode(raised))


# Requests allowed per number of seconds.
LIMITS = {"anonymous": (100, 3600), "authenticated": (1000, 3600), "login": (10, 600), "api": (500, 3600), "download": (50, 3600)}


def limits(table: dict[str, tuple[int, int]] | None = None) -> tuple[Column, Column]:
    """Requests allowed to a request and the life of its counters in seconds:
    by endpoint class, else by whether the user is known."""
    table = table or LIMITS

    def pick(i: int) -> Column:
        value = F.when(F.col("user_id").isNotNull(), table["authenticated"][i]).otherwise(table["anonymous"][i])
        for endpoint in ("login", "api", "download"):
            value = F.when(F.col("endpoint") == endpoint, table[endpoint][i]).otherwise(value)
        return value

    return pick(0), pick(1)


def sessions(events: DataFrame, key: str, ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """Activity sessions per key, closed after ``gap_seconds`` of silence; gaps
    and session numbers are computed in chunks, so a busy key is split."""
    slim = prefix.cut(events.select(key, ts, tie), [ts, tie])
    chunk = F.col(prefix.CHUNK)
    seen = prefix.previous(slim, [key], [ts, tie], {"_before": ts}, chunk=chunk)
    apart = F.unix_micros(ts) - F.unix_micros("_before")
    opens = F.when(F.col("_before").isNull() | (apart >= gap_seconds * 1_000_000), 1).otherwise(0).cast("long")
    numbered = prefix.running(seen, [key], [ts, tie], {"session": opens}, chunk=chunk)
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("requests"))


def over_limit(found: DataFrame, limit: int) -> DataFrame:
    return found.where(F.col("requests") > limit)


def integrity_hash(columns: list[str], key: bytes) -> Column:
    return hmac_sha256(key, canonical_json(columns))


def tampered(events: DataFrame, columns: list[str], stored: str, key: bytes) -> DataFrame:
    """Rows without a hash or with a hash that does not fit the content."""
    return events.where(F.col(stored).isNull() | (F.col(stored) != integrity_hash(columns, key)))


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Create, update and delete events between two versions of a table, with
    the changed fields."""
    a, b = old.alias("a"), new.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    differs = {c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns}
    fields = F.array_compact(F.array(*[F.when(d, F.lit(c)) for c, d in differs.items()]))
    gone, fresh = F.col(f"b.{key}").isNull(), F.col(f"a.{key}").isNull()
    changed = any_of(list(differs.values()))
    action = F.when(fresh, "MODEL_CREATED").when(gone, "MODEL_DELETED").when(changed, "MODEL_UPDATED")
    return j.select(
        F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key),
        action.alias("action"),
        F.when(gone, "MEDIUM").otherwise("LOW").alias("severity"),
        F.when(action == "MODEL_UPDATED", F.array_join(fields, ",")).alias("changed"),
    ).where(F.col("action").isNotNull())


def request_status(status: Column) -> tuple[Column, Column]:
    """Success flag and severity of a response."""
    ok = status.between(200, 399)
    return ok, F.when(ok, "LOW").when(status < 500, "MEDIUM").otherwise("HIGH")
