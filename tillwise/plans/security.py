"""Catalogue: security logs and audit trail."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwise.functions.columns import text
from tillwise.operators import folds, logs
from tillwise.plans.registry import query

KEY = b"audit-integrity-key"

BURST_SQL = """burst AS (SELECT user_id, time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '2000-01-01') AS a, count(*) AS c FROM log_entries WHERE action = 'login' AND status >= 400 GROUP BY 1, 2 HAVING count(*) >= 5)"""
EXPORT_SQL = """spike AS (SELECT user_id, count(*) AS c, min(ts) AS a, max(ts) AS b FROM log_entries WHERE lower(action) LIKE '%export%' OR lower(endpoint) LIKE '%export%' OR lower(message) LIKE '%export%' GROUP BY 1 HAVING count(*) > 10)"""
API_SQL = """api AS (SELECT user_id, count(*) AS c, min(ts) AS a, max(ts) AS b FROM log_entries WHERE endpoint <> '' GROUP BY 1 HAVING count(*) > 80 AND epoch(max(ts) - min(ts)) < 3600)"""
IP_SQL = """ips AS (SELECT ip, count(DISTINCT user_id) AS users, count(*) AS c, min(ts) AS a, max(ts) AS b FROM log_entries GROUP BY 1 HAVING count(DISTINCT user_id) > 5)"""


def shown(df, *extra):
    return df.select(*extra, text("first_seen").alias("first_seen"), text("last_seen").alias("last_seen"))


@query("log_failed_login_burst", f"WITH {BURST_SQL} SELECT user_id, c AS count, CAST(a AS VARCHAR) AS first_seen, CAST(a + INTERVAL 5 MINUTES AS VARCHAR) AS last_seen FROM burst")
def _(t):
    return shown(logs.failed_login_burst(t.log_entries), "user_id", "count")


@query(
    "log_burst_entries",
    f"""WITH {BURST_SQL} SELECT event_id, l.user_id FROM log_entries l JOIN burst b ON l.user_id = b.user_id AND time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '2000-01-01') = b.a WHERE action = 'login' AND status >= 400""",
)
def _(t):
    return logs.burst_entries(t.log_entries, logs.failed_login_burst(t.log_entries)).select("event_id", "user_id")


@query(
    "log_export_spike",
    f"""WITH {EXPORT_SQL}, e AS (SELECT l.user_id, event_id, row_number() OVER (PARTITION BY l.user_id ORDER BY ts, event_id) AS position FROM log_entries l WHERE lower(action) LIKE '%export%')
SELECT s.user_id, c AS count, CAST(a AS VARCHAR) AS first_seen, CAST(b AS VARCHAR) AS last_seen, CAST(position AS INTEGER) AS position, event_id FROM spike s JOIN e ON s.user_id = e.user_id WHERE position <= 10""",
)
def _(t):
    spikes = logs.export_spike(t.log_entries)
    entries = logs.first_entries(t.log_entries.where(logs.is_export()), spikes, "user_id").select("user_id", "position", "event_id")
    return shown(spikes.join(entries, "user_id"), "user_id", "count", "position", "event_id")


@query("log_suspicious_api", f"WITH {API_SQL} SELECT user_id, c AS count, CAST(a AS VARCHAR) AS first_seen, CAST(b AS VARCHAR) AS last_seen FROM api")
def _(t):
    return shown(logs.suspicious_api(t.log_entries, more_than=80), "user_id", "count")


@query(
    "log_ip_many_users",
    f"""WITH {IP_SQL} SELECT DISTINCT ips.ip, users, c AS count, CAST(a AS VARCHAR) AS first_seen, CAST(b AS VARCHAR) AS last_seen, user_id FROM ips JOIN log_entries l ON ips.ip = l.ip""",
)
def _(t):
    flagged = logs.ip_many_users(t.log_entries)
    return shown(logs.ip_users(t.log_entries, flagged), "ip", "users", "count", "user_id")


@query(
    "log_report",
    f"""WITH {BURST_SQL}, {EXPORT_SQL}, {API_SQL.replace("> 80", "> 100")}, {IP_SQL},
r AS (SELECT 'failed_login_burst' AS type, printf('User %s had %d failed login attempts in 5 minutes', user_id, c) AS description, c, '5 minutes' AS w, a, a + INTERVAL 5 MINUTES AS b FROM burst
UNION ALL SELECT 'data_export_spike', printf('User %s performed %d data exports', user_id, c), c, printf('%.1f hours', epoch(b - a) / 3600), a, b FROM spike
UNION ALL SELECT 'suspicious_api_access', printf('User %s made %d API requests in %.1f minutes', user_id, c, epoch(b - a) / 60), c, printf('%.1f minutes', epoch(b - a) / 60), a, b FROM api
UNION ALL SELECT 'ip_multiple_users', printf('IP %s accessed by %d different users', ip, users), c, printf('%.1f hours', epoch(b - a) / 3600), a, b FROM ips)
SELECT type, description, c AS count, w AS time_window, CAST(a AS VARCHAR) AS first_seen, CAST(b AS VARCHAR) AS last_seen FROM r""",
)
def _(t):
    return shown(logs.report(t.log_entries), "type", "description", "count", "time_window")


@query(
    "log_stats",
    "SELECT 'level' AS section, level AS item, count(*) AS n FROM log_entries GROUP BY level UNION ALL SELECT 'status', CAST(status // 100 AS VARCHAR) || 'xx', count(*) FROM log_entries GROUP BY 2",
)
def _(t):
    return logs.stats(t.log_entries)


@query(
    "sec_alerts",
    """
SELECT event_id, 'CRITICAL_SECURITY_EVENT' AS alert_type FROM audit_events WHERE severity = 'CRITICAL' UNION ALL SELECT event_id, 'DATA_ACCESS_VIOLATION' FROM audit_events WHERE action = 'PII_ACCESS' AND NOT success
UNION ALL SELECT event_id, 'SYSTEM_INTEGRITY_VIOLATION' FROM audit_events WHERE action = 'SECURITY_CONFIG_CHANGED'""",
)
def _(t):
    return logs.alerts(t.audit_events).select("event_id", "alert_type")


SESSION_SQL = """s AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL {gap} THEN 1 ELSE 0 END AS o FROM {table} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s), sessions AS (SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS requests FROM n GROUP BY user_id, session)"""


# Requests and seconds for the generated events, which are sparse: (endpoint class or None, user known) → limit.
SPARSE_LIMITS = {"login": (3, 86400), "api": (6, 86400), "download": (4, 86400), "authenticated": (8, 86400), "anonymous": (5, 43200)}


def _counter_sql(name: str, source: str, keys: list[str], asked: str) -> str:
    """One counter over the requests that are still open."""
    part, same = ", ".join(keys), " AND ".join(f"a.{k} = s.{k}" for k in keys)
    cols = "event_id, ts, ip, user_id, endpoint, us, most, hold"
    return f"""
{name}_a AS (SELECT {cols}, row_number() OVER (PARTITION BY {part} ORDER BY ts, event_id) AS rn FROM {source} WHERE refused_by IS NULL AND {asked}),
{name}_s AS (
  SELECT {cols}, rn, CAST(1 AS BIGINT) AS c, us + hold AS expires, false AS no FROM {name}_a WHERE rn = 1
  UNION ALL
  SELECT a.event_id, a.ts, a.ip, a.user_id, a.endpoint, a.us, a.most, a.hold, a.rn,
    CASE WHEN a.us >= s.expires THEN 1 WHEN s.c >= a.most THEN s.c ELSE s.c + 1 END,
    CASE WHEN a.us < s.expires AND s.c >= a.most THEN s.expires ELSE a.us + a.hold END,
    a.us < s.expires AND s.c >= a.most
  FROM {name}_s s JOIN {name}_a a ON {same} AND a.rn = s.rn + 1),
{name} AS (SELECT {cols}, CASE WHEN no THEN '{name}' END AS refused_by FROM {name}_s UNION ALL SELECT {cols}, refused_by FROM {source} WHERE NOT (refused_by IS NULL AND {asked}))"""


def _limit_sql(at: int) -> str:
    """Requests (0) or seconds (1) of the class of a request."""
    limit = {k: v[at] for k, v in SPARSE_LIMITS.items()}
    return f"""CASE WHEN endpoint = 'login' THEN {limit['login']} WHEN endpoint = 'api' THEN {limit['api']} WHEN endpoint = 'download' THEN {limit['download']}
  WHEN endpoint IS NULL AND user_id IS NOT NULL THEN {limit['authenticated']} WHEN endpoint IS NULL THEN {limit['anonymous']} END"""



@query(
    "sec_rate_limit",
    f"""
WITH RECURSIVE r AS (
  SELECT event_id, ts, '10.0.' || CAST(user_id % 40 AS VARCHAR) AS ip, CASE WHEN user_id % 4 <> 0 THEN user_id END AS user_id,
    CASE event_type WHEN 'signup' THEN 'login' WHEN 'view' THEN 'api' WHEN 'click' THEN 'download' END AS endpoint, epoch_us(ts) AS us FROM events),
q AS (SELECT *, {_limit_sql(0)} AS most, CAST({_limit_sql(1)} AS BIGINT) * 1000000 AS hold, CAST(NULL AS VARCHAR) AS refused_by FROM r),
{_counter_sql("ip", "q", ["ip"], "true")},
{_counter_sql("user", "ip", ["user_id"], "user_id IS NOT NULL").replace("user_a", "usr_a").replace("user_s", "usr_s").replace("user AS", "usr AS")},
{_counter_sql("endpoint", "usr", ["endpoint", "ip"], "endpoint IS NOT NULL").replace("endpoint_a", "end_a").replace("endpoint_s", "end_s").replace("endpoint AS (", "ended AS (")}
SELECT event_id, refused_by FROM ended""",
)
def _(t):
    requests = t.events.select(
        "event_id",
        "ts",
        F.concat(F.lit("10.0."), text(F.col("user_id") % 40)).alias("ip"),
        F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_type") == "signup", "login").when(F.col("event_type") == "view", "api").when(F.col("event_type") == "click", "download").alias("endpoint"),
    )
    return folds.rate_limit(requests, "ts", "event_id", *logs.limits(SPARSE_LIMITS)).select("event_id", "refused_by")


@query(
    "sec_sessions",
    f"WITH {SESSION_SQL.format(gap='12 HOURS', table='events')} SELECT user_id, CAST(started AS VARCHAR) AS started, CAST(ended AS VARCHAR) AS ended, requests FROM sessions WHERE requests > 10",
)
def _(t):
    found = logs.over_limit(logs.sessions(t.events, "user_id", "ts", "event_id", 43200), 10)
    return found.select("user_id", text("started").alias("started"), text("ended").alias("ended"), "requests")


HASHED = ["action", "event_id", "severity", "user_id"]
# HMAC as SQL: the padded key is a literal, the inner digest is hashed again.
_PAD = KEY.ljust(64, b"\0")
INNER, OUTER = bytes(b ^ 0x36 for b in _PAD).hex(), bytes(b ^ 0x5C for b in _PAD).hex()
PAYLOAD = """'{"action":"' || action || '","event_id":' || CAST(event_id AS VARCHAR) || ',"severity":"' || severity || '","user_id":' || CAST(user_id AS VARCHAR) || '}'"""
HMAC_SQL = f"sha256(from_hex('{OUTER}' || sha256(from_hex('{INNER}' || hex(CAST({PAYLOAD} AS BLOB))))))"


@query("sec_integrity_hash", f"SELECT event_id, {HMAC_SQL} AS integrity_hash FROM audit_events")
def _(t):
    return t.audit_events.select("event_id", logs.integrity_hash(HASHED, KEY).alias("integrity_hash"))


@query("sec_integrity_verify", "SELECT event_id, severity FROM audit_events WHERE k % 20 = 3 AND severity <> 'LOW' OR k % 20 = 7")
def _(t):
    signed = t.audit_events.withColumn("stored", F.when(F.col("k") % 20 != 7, logs.integrity_hash(HASHED, KEY)))
    # some severities are altered after signing
    altered = signed.withColumn("declared", F.col("severity")).withColumn("severity", F.when(F.col("k") % 20 == 3, "LOW").otherwise(F.col("severity")))
    return logs.tampered(altered, HASHED, "stored", KEY).select("event_id", F.col("declared").alias("severity"))


@query(
    "sec_change_capture",
    """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'MODEL_CREATED' WHEN c_custkey % 11 = 0 THEN 'MODEL_DELETED' ELSE 'MODEL_UPDATED' END AS action,
  CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'c_mktsegment' END, CASE WHEN c_custkey % 5 = 0 AND c_acctbal <> 0 THEN 'c_acctbal' END) END AS changed
FROM customer WHERE (c_custkey % 7 = 0 AND c_custkey % 11 <> 0) OR (c_custkey % 7 <> 0 AND c_custkey % 11 = 0) OR (c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND (c_custkey % 3 = 0 OR (c_custkey % 5 = 0 AND c_acctbal <> 0)))""",
)
def _(t):
    k = F.col("c_custkey")
    old = t.customer.where(k % 7 != 0)
    new = t.customer.where(k % 11 != 0).withColumns(
        {
            "c_mktsegment": F.when(k % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")),
            "c_acctbal": F.when(k % 5 == 0, F.col("c_acctbal") * 2).otherwise(F.col("c_acctbal")),
        }
    )
    return logs.changes(old, new, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query(
    "sec_request_status",
    """
WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 302 WHEN 2 THEN 404 ELSE 503 END AS status FROM events)
SELECT event_id, status BETWEEN 200 AND 399 AS success, CASE WHEN status BETWEEN 200 AND 399 THEN 'LOW' WHEN status < 500 THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM x""",
)
def _(t):
    k = F.col("event_id") % 4
    ok, severity = logs.request_status(F.when(k == 0, 200).when(k == 1, 302).when(k == 2, 404).otherwise(503))
    return t.events.select("event_id", ok.alias("success"), severity.alias("severity"))
