"""Privacy requests: reports, consents, retention, subject access, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.crypto import hmac_sha256
from tillwise.operators.sets import union_all
from tillwise.operators.windows import top_per_key


def days(n) -> Column:
    return F.make_dt_interval(F.lit(n) if isinstance(n, int) else n)


# --- tokens -------------------------------------------------------------------


def new_tokens(values: DataFrame, column: str, kind: str, vault: DataFrame, key: bytes) -> DataFrame:
    """Vault rows for values without a token. The token is keyed by the value,
    so a retried task writes the same one."""
    fresh = values.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    token = F.concat(F.lit(f"tok_{kind}_"), F.left(hmac_sha256(key, F.concat(F.lit(kind + ":"), "value")), F.lit(16)))
    return fresh.join(vault.select("value"), "value", "left_anti").select("value", token.alias("token"))


def tokenize(df: DataFrame, column: str, vault: DataFrame) -> DataFrame:
    """Replace values by their vault tokens."""
    v = vault.select(F.col("value").alias("_value"), F.col("token").alias("_token"))
    return df.join(v, F.col(column).cast("string") == F.col("_value"), "left").withColumn(column, F.col("_token")).drop("_value", "_token")


def detokenize(df: DataFrame, column: str, vault: DataFrame) -> DataFrame:
    """Values of known tokens; other text stays."""
    v = vault.select(F.col("value").alias("_value"), F.col("token").alias("_token"))
    return df.join(v, F.col(column) == F.col("_token"), "left").withColumn(column, F.coalesce("_value", column)).drop("_value", "_token")


# --- keys -----------------------------------------------------------------------


def key_usable(active: Column, expires: Column, now: Column) -> Column:
    return active & (expires.isNull() | (expires > now))


def key_usage(rows: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Validity of every key version with its usage count and last use."""
    used = rows.groupBy("key_id", "version").agg(F.count("*").alias("usage_count"), F.max("ts").alias("last_used"))
    return keys.join(used, ["key_id", "version"], "left").select(
        "key_id", "version", key_usable(F.col("active"), F.col("expires"), now).alias("is_valid"),
        F.coalesce("usage_count", F.lit(0)).alias("usage_count"), "last_used",
    )


# --- access report ----------------------------------------------------------------

# Newest records shown per subject and section; the counts beside them are of all.
LIMITS = {"processing_activities": 100, "sharing_information": 50, "automated_processing": 20, "consent_records": 1000, "data_sources": 1000}

# Fields of a record, by section.
RECORDS = {
    "processing_activities": ("kind", "purpose", "legal_basis", "ts", "system", "processor", "data_categories", "is_compliant"),
    "sharing_information": ("ts", "recipients", "purpose", "legal_basis", "data_categories"),
    "automated_processing": ("ts", "system", "purpose", "logic", "significance", "consequences"),
    "consent_records": ("purpose", "legal_basis", "is_active", "given", "withdrawn", "expiry", "source", "version"),
    "data_sources": ("location", "pii_type", "category", "sensitivity", "is_encrypted", "is_tokenized", "record_count", "last_verified"),
}
BASIC = ("subject_id", "external_id", "email", "phone", "name")
ACCOUNT = ("is_active", "consent_given", "consent_date", "deletion_requested", "deletion_scheduled")
PROFILE = ("data_sources", "processing_purposes", "legal_basis")
POLICY = ("name", "category", "retention_days", "action")
UNSAID = "Not specified"


def _section(df: DataFrame, name: str, order: list) -> DataFrame:
    """The first records per subject as one list, bounded before collecting."""
    top = top_per_key(df, ["subject_id"], order, LIMITS[name])
    record = F.struct("rn", F.struct(*RECORDS[name]).alias("r"))
    return top.groupBy("subject_id").agg(F.transform(F.array_sort(F.collect_list(record)), lambda x: x.r).alias(name))


def access_report(subjects: DataFrame, activity: DataFrame, consents: DataFrame, places: DataFrame, policies: DataFrame, today: Column) -> DataFrame:
    """One row per subject with seven sections of whole records.

    ``subjects``: profile, one row each. ``activity``: processing records (kind,
    ts, event_id, …). ``places``: where data of a subject lies. ``policies``: the
    retention policies, of which the active ones (a short list) are shown to
    everyone. Lists are cut to ``LIMITS``; ``consent_count`` and ``place_count``
    tell how many there are."""
    newest = [F.desc("ts"), F.desc("event_id")]
    said = {c: F.coalesce(c, F.lit(UNSAID)) for c in ("logic", "significance", "consequences")}
    parts = [
        _section(activity, "processing_activities", newest),
        _section(activity.where("kind = 'TRANSMISSION'"), "sharing_information", newest),
        _section(activity.where("kind = 'ANALYSIS' AND automated").withColumns(said), "automated_processing", newest),
        _section(consents, "consent_records", [F.desc("given"), F.desc("consent_id")]),
        _section(places, "data_sources", [F.asc("location")]),
        consents.groupBy("subject_id").agg(F.count("*").alias("consent_count")),
        places.groupBy("subject_id").agg(F.count("*").alias("place_count")),
    ]
    profile = subjects.select(
        "subject_id",
        F.struct(F.struct(*BASIC).alias("basic_information"), F.struct(*ACCOUNT).alias("account_status"), *PROFILE).alias("personal_data"),
        "deletion_scheduled",
    )
    out = estimated_deletion(profile, places, policies, today)
    for p in parts:
        out = out.join(p, "subject_id", "left")
    listed = policies.where("is_active").select(F.struct(*POLICY).alias("p")).agg(F.array_sort(F.collect_list("p"))).scalar()
    lists = {c: F.coalesce(c, F.array()) for c in RECORDS}
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("consent_count", "place_count")}
    retention = F.struct(listed.alias("policies"), F.col("estimated_deletion").alias("estimated_deletion_date"))
    return out.withColumns({**lists, **counts, "retention_information": retention}).select("subject_id", "personal_data", *RECORDS, "retention_information", *counts)


def estimated_deletion(subjects: DataFrame, places: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """Scheduled date, else today plus the longest retention of the subject's data."""
    longest = (
        places.join(policies.where("is_active"), "category").groupBy("subject_id").agg(F.max("retention_days").alias("d"))
    )
    return subjects.join(longest, "subject_id", "left").withColumn(
        "estimated_deletion", F.coalesce("deletion_scheduled", F.when(F.col("d") > 0, F.date_add(now, F.col("d"))))
    ).drop("d")


# --- consents ---------------------------------------------------------------------


def record_consents(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """New consents: first per subject, purpose and version without an active one."""
    keys = ["subject_id", "purpose", "version"]
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("given", "consent_id")).alias("_r")).select(*keys, "_r.*")
    return first.join(existing.where("is_active").select(*keys), keys, "left_anti")


def withdraw(consents: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Requests name a subject and, optionally, a purpose (null = all)."""
    everything = requests.where(F.col("purpose").isNull()).select("subject_id").distinct().withColumn("_a", F.lit(True))
    one = requests.where(F.col("purpose").isNotNull()).select("subject_id", "purpose").distinct().withColumn("_b", F.lit(True))
    j = consents.join(everything, "subject_id", "left").join(one, ["subject_id", "purpose"], "left")
    hit = F.col("is_active") & (F.coalesce("_a", F.lit(False)) | F.coalesce("_b", F.lit(False)))
    return j.withColumns(
        {"withdrawn": F.when(hit, now).otherwise(F.col("withdrawn")), "is_active": F.col("is_active") & ~hit}
    ).drop("_a", "_b")


def consent_status(consents: DataFrame, now: Column) -> DataFrame:
    late = F.coalesce(F.col("expiry") < now, F.lit(False))
    return consents.groupBy("subject_id").agg(
        F.count_if("is_active").alias("active_consents"),
        F.count_if(F.col("is_active") & late).alias("expired_count"),
    )


def expire(consents: DataFrame, now: Column) -> DataFrame:
    late = F.col("is_active") & F.coalesce(F.col("expiry") < now, F.lit(False))
    return consents.withColumns(
        {"withdrawn": F.when(late, now).otherwise(F.col("withdrawn")), "is_active": F.col("is_active") & ~late}
    )


# --- retention ----------------------------------------------------------------------


def retention_plan(subjects: DataFrame, places: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """Due subjects, their locations and the action of the active policy (dry run)."""
    due = subjects.where(F.col("deletion_requested") & F.col("is_active") & (F.col("deletion_scheduled") < now))
    return due.select("subject_id").join(places, "subject_id").join(policies.where("is_active"), "category").select(
        "subject_id", "location", "category", "policy_action"
    )


def apply_action(table: DataFrame, key: str, due: DataFrame, action: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """New content of a table and the rows moved to the archive."""
    ids = due.select(F.col("subject_id").alias(key)).distinct()
    if action == "DELETE":
        return table.join(ids, key, "left_anti"), table.limit(0)
    if action == "ARCHIVE":
        return table.join(ids, key, "left_anti"), table.join(ids, key, "left_semi")
    if action == "ANONYMIZE":
        marked = table.join(ids.withColumn("_due", F.lit(True)), key, "left")
        clear = {f: F.when(F.col("_due").isNull(), F.col(f)) for f in fields}
        return marked.withColumns(clear).select(*table.columns), table.limit(0)
    raise ValueError(f"unknown action {action}")


def schedule(requested: Column, n: int = 30) -> Column:
    return F.date_add(requested, n)


def request_due(requests: DataFrame, today: Column, default_days: int = 30) -> DataFrame:
    due = F.coalesce("due_date", F.date_add("received", default_days))
    return requests.withColumns(
        {
            "due": due,
            "is_overdue": (due < today) & ~F.col("status").isin("COMPLETED", "REJECTED"),
            "days_until_due": F.greatest(F.datediff(due, today), F.lit(0)),
        }
    )


# --- subject access over tables -------------------------------------------------------

# Personal fields by table.
PII_FIELDS = {"users": ("email", "ssn", "phone"), "customers": ("email", "phone", "address")}


def find_subject_rows(tables: dict[str, DataFrame], requests: DataFrame, field: str) -> DataFrame:
    """Rows of every table that belong to a requested identifier, as JSON; many
    requests are answered by one join per table."""
    found = []
    for name, df in tables.items():
        j = df.join(requests, F.col(field) == F.col("identifier"))
        found.append(j.select("identifier", F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("record")))
    return union_all(found)


def anonymize(df: DataFrame, fields) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({f: F.lit(None).cast(kinds[f]) for f in fields if f in kinds})


def subject_report(found: DataFrame) -> DataFrame:
    return found.groupBy("identifier", "table").agg(F.count("*").alias("rows"))
