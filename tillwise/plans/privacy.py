"""Catalogue: personal data, encryption, tokens and privacy requests."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tillwise.functions import crypto, pii
from tillwise.functions.columns import text
from tillwise.operators import marts, privacy
from tillwise.plans.joins import MAPS_SQL, policies
from tillwise.plans.registry import query
from tillwise.session import spread

KEY = b"0123456789abcdef0123456789abcdef"


def sql_text(pattern: str) -> str:
    return pattern.replace("'", "''")


def every(pattern: str, flags: str = "") -> str:
    return f"regexp_extract_all(body, '{flags}{sql_text(pattern)}')"


GOOD_EMAIL = r"""NOT starts_with(e, '.') AND NOT contains(e, '..') AND NOT contains(e, '.@') AND position('@' IN e) <= 65 AND NOT contains(split_part(e, '@', 2), '|')
  AND NOT regexp_matches(split_part(e, '@', 2), '(^|\.)-|-(\.|$)|^\.') AND NOT regexp_matches(lower(e), '\.(arpa|invalid|local|localhost|onion|test)$')"""
LUHN = """list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substring(reverse(d), i + 1, 1) AS INTEGER)
  ELSE (CAST(substring(reverse(d), i + 1, 1) AS INTEGER) * 2) // 10 + (CAST(substring(reverse(d), i + 1, 1) AS INTEGER) * 2) % 10 END)) % 10 = 0"""

# Values each kind reports, as (text_id, v) rows.
FOUND_SQL = {
    "email": f"SELECT text_id, e AS v FROM (SELECT text_id, unnest({every(pii.EMAIL, '(?i)')}) AS e FROM texts) WHERE {GOOD_EMAIL}",
    "phone": f"""SELECT text_id, p AS v FROM (SELECT text_id, unnest({every(pii.PHONES['US'])}) AS p FROM texts) WHERE regexp_matches(regexp_replace(p, '[^\\d+]', '', 'g'), '^\\+1[2-9]\\d{{2}}[2-9]\\d{{6}}$')
UNION ALL SELECT text_id, p FROM (SELECT text_id, unnest({every(pii.PHONES['UK'])}) AS p FROM texts) WHERE regexp_matches(regexp_replace(p, '[^\\d+]', '', 'g'), '^\\+447[1-9]\\d{{8}}$')""",
    "ssn": f"SELECT text_id, s AS v FROM (SELECT text_id, unnest({every(pii.SSN)}) AS s FROM texts) WHERE NOT starts_with(s, '000') AND substring(s, 5, 2) <> '00' AND NOT ends_with(s, '0000')",
    "credit_card": "SELECT text_id, v FROM (SELECT text_id, v, regexp_replace(v, '[\\s-]', '', 'g') AS d FROM ("
    + " UNION ALL ".join(f"SELECT text_id, unnest({every(p)}) AS v FROM texts" for p in pii.CARDS.values())
    + f")) WHERE {LUHN}",
    "national_id": " UNION ALL ".join(f"SELECT text_id, unnest({every(p)}) AS v FROM texts" for p in pii.NATIONAL_IDS.values()),
    "ip_address": f"SELECT text_id, v FROM (SELECT text_id, unnest({every(pii.IPV4)}) AS v FROM texts) WHERE len(list_filter(string_split(v, '.'), lambda x: CAST(x AS INTEGER) > 255)) = 0",
    "name": " UNION ALL ".join(f"SELECT text_id, unnest({every(p)}) AS v FROM texts WHERE field = 'customer_note'" for p in pii.NAMES.values()),
}


def _hits(order: int, kind: str, sure: float, level: str, pattern: str, good: str, flags: str = "") -> str:
    """Matches of a pattern with their places: the text is split at them, and a
    match starts behind all pieces and matches before it."""
    p = flags + sql_text(pattern)
    return f"""
SELECT text_id, field, {order} AS o, '{kind}' AS type, CAST({sure} AS DOUBLE) AS confidence, start, start + length(v) AS "end", v AS value, '{level}' AS level FROM (
  SELECT text_id, field, unnest(vs) AS v, unnest([CAST(list_sum(list_transform(ps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(vs[1:k - 1], lambda x: length(x))), 0) AS BIGINT) for k in range(1, len(vs) + 1)]) AS start
  FROM (SELECT text_id, field, regexp_extract_all(body, '{p}') AS vs, string_split_regex(body, '{p}') AS ps FROM texts) WHERE len(vs) > 0) WHERE {good}"""


DIGITS = "regexp_replace(v, '[^\\d+]', '', 'g')"
HITS = [
    ("email", 0.95, "MEDIUM", pii.EMAIL, re.sub(r"\be\b", "v", GOOD_EMAIL), "(?i)"),
    ("phone", 0.9, "MEDIUM", pii.PHONES["US"], f"regexp_matches({DIGITS}, '^\\+1[2-9]\\d{{2}}[2-9]\\d{{6}}$|^\\+447[1-9]\\d{{8}}$')"),
    ("phone", 0.9, "MEDIUM", pii.PHONES["UK"], f"regexp_matches({DIGITS}, '^\\+1[2-9]\\d{{2}}[2-9]\\d{{6}}$|^\\+447[1-9]\\d{{8}}$')"),
    ("ssn", 0.8, "HIGH", pii.SSN, "NOT starts_with(v, '000') AND substring(v, 5, 2) <> '00' AND NOT ends_with(v, '0000')"),
    *[("credit_card", 0.9, "CRITICAL", p, re.sub(r"\bd\b", "regexp_replace(v, '[\\\\s-]', '', 'g')", LUHN)) for p in pii.CARDS.values()],
    *[("national_id", 0.8, "HIGH", p, "true") for p in pii.NATIONAL_IDS.values()],
    ("ip_address", 0.8, "LOW", pii.IPV4, "len(list_filter(string_split(v, '.'), lambda x: CAST(x AS INTEGER) > 255)) = 0"),
]
# Hits by start; of hits that meet, the first stays unless a later one is more certain.
SPANS_SQL = f"""
hits AS ({" UNION ALL ".join(_hits(o, *h) for o, h in enumerate(HITS))}),
lists AS (SELECT text_id, field, list([struct_pack(s := start, e := "end", c := confidence, t := type, v := value, l := level)] ORDER BY start, o) AS h FROM hits GROUP BY text_id, field),
swept AS (SELECT text_id, field, unnest(list_reduce(h, lambda a, x: CASE WHEN a[-1].e < x[1].s THEN a || x WHEN x[1].c > a[-1].c THEN a[:-2] || x ELSE a END)) AS m FROM lists),
spans AS (SELECT text_id, field, m.t AS type, m.c AS confidence, CAST(m.s AS INTEGER) AS start, CAST(m.e AS INTEGER) AS "end", m.v AS value, m.l AS level FROM swept)"""


def detector(qid: str, kind: str):
    @query(qid, f"SELECT text_id, v AS value, count(*) AS n FROM ({FOUND_SQL[kind]}) GROUP BY 1, 2")
    def _(t):
        rows = t.texts.where(F.col("field") == "customer_note") if kind == "name" else t.texts
        values = rows.select("text_id", F.explode(pii.found(F.col("body"), kind, "customer_note" if kind == "name" else "text")).alias("value"))
        return values.groupBy("text_id", "value").agg(F.count("*").alias("n"))


detector("pii_email", "email")
detector("pii_phone", "phone")
detector("pii_ssn", "ssn")
detector("pii_credit_card", "credit_card")
detector("pii_national_id", "national_id")
detector("pii_ip", "ip_address")
detector("pii_name", "name")


@query("pii_scan_text", f"WITH {SPANS_SQL} SELECT text_id, type, confidence, start, \"end\", value, level FROM spans")
def _(t):
    spans = t.texts.select("text_id", F.explode(pii.scan(F.col("body"))).alias("m"))
    return spans.select("text_id", "m.*")


@query(
    "pii_scan_nested",
    """
SELECT c_custkey, 'contact.email' AS path, 'email' AS type, lower(replace(c_name, '#', '.')) || '@example.com' AS value FROM customer
UNION ALL SELECT c_custkey, 'contact.phones[1]', 'phone', '+1202555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') FROM customer
UNION ALL SELECT c_custkey, 'visits[0].ip', 'ip_address', '10.0.0.' || CAST(c_custkey % 200 AS VARCHAR) FROM customer""",
)
def _(t):
    nested = spread(t.clients.select("customer_id", "email", "phone")).select(
        F.col("customer_id").alias("c_custkey"),
        F.struct("email", F.array(F.lit("none"), F.col("phone")).alias("phones")).alias("contact"),
        F.array(F.struct(F.concat(F.lit("10.0.0."), text(F.col("customer_id") % 200)).alias("ip"), F.lit(1).alias("n"))).alias("visits"),
    )
    return pii.scan_leaves(pii.leaves(nested, ["c_custkey"]), ["c_custkey"]).select("c_custkey", "path", "type", "value")


RATE_SQL = " UNION ALL ".join(
    f"SELECT 'body' AS \"column\", '{k}' AS type, count(DISTINCT text_id) AS matching, (SELECT count(*) FROM texts) AS values FROM ({FOUND_SQL[k]})"
    for k in ("email", "phone", "ssn", "credit_card", "national_id", "ip_address")
)


@query("pii_scan_table", f"WITH r AS ({RATE_SQL}) SELECT *, CAST(matching AS DOUBLE) / values AS rate FROM r WHERE matching > 0")
def _(t):
    return pii.scan_table(t.texts.select("body"))


@query(
    "pii_classify_type",
    "SELECT type, n, CASE WHEN type IN ('email', 'phone', 'ssn', 'national_id', 'name') THEN 'IDENTIFIERS' WHEN type = 'credit_card' THEN 'FINANCIAL' ELSE 'LOCATION' END AS category, CASE WHEN type IN ('email', 'phone', 'ssn', 'national_id', 'name') THEN 'MEDIUM' WHEN type = 'credit_card' THEN 'CRITICAL' ELSE 'LOW' END AS level FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS type, count(*) AS n FROM ({FOUND_SQL[k]})" for k in FOUND_SQL)
    + ")",
)
def _(t):
    # names are looked for in the notes only, as in the detector of their own
    field = F.col("field") == "customer_note"
    size = lambda k: F.when(field, F.size(pii.found(F.col("body"), k, "customer_note"))).otherwise(0) if k == "name" else F.size(pii.found(F.col("body"), k, short=F.col("_short")))
    counts = t.texts.withColumn("_short", pii.numbers(F.col("body"))).agg(*[F.coalesce(F.sum(size(k)), F.lit(0)).alias(k) for k in FOUND_SQL]).unpivot([], list(FOUND_SQL), "type", "n")
    return counts.select("type", "n", pii.category_of(F.col("type")).alias("category"), pii.level_of(F.col("type")).alias("level"))


def field_spans(t):
    """Spans of the texts by field: documents by language, notes by group."""
    field = F.when(F.col("field") == "text", F.lit("text")).otherwise(F.concat(F.lit("note_"), text(F.length("text_id"))))
    return t.texts.select(field.alias("path"), F.explode(pii.scan(F.col("body"))).alias("m")).select("path", "m.type", "m.confidence")


FIELDS_SQL = f"""
WITH {SPANS_SQL},
paths AS (SELECT CASE WHEN field = 'text' THEN 'text' ELSE 'note_' || CAST(length(text_id) AS VARCHAR) END AS path, type, confidence FROM spans),
kinds AS (SELECT path, type, max(confidence) AS c, count(*) AS n,
  CASE type WHEN 'credit_card' THEN 'FINANCIAL' WHEN 'ip_address' THEN 'LOCATION' ELSE 'IDENTIFIERS' END AS category,
  CASE type WHEN 'credit_card' THEN 4 WHEN 'ip_address' THEN 1 ELSE 2 END AS rank FROM paths GROUP BY path, type),
fields AS (
  SELECT path, CASE max(rank) WHEN 4 THEN 'CRITICAL' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS pii_level, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories,
    array_to_string(list_sort(list(type)), ',') AS types, max(c) AS confidence, CAST(sum(n) AS BIGINT) AS match_count FROM kinds GROUP BY path)"""


@query("pii_classify_field", f"{FIELDS_SQL} SELECT path, pii_level, categories, types, confidence, match_count FROM fields")
def _(t):
    return pii.classify_fields(field_spans(t))


@query(
    "agg_pii_data_map",
    f"""{FIELDS_SQL}
SELECT 'pii_fields' AS section, 'all' AS item, count(*) AS n FROM fields UNION ALL SELECT 'total_fields', 'all', count(DISTINCT field) FROM texts
UNION ALL SELECT 'level', pii_level, count(*) FROM fields GROUP BY pii_level
UNION ALL SELECT 'category', item, count(*) FROM (SELECT unnest(string_split(categories, ',')) AS item FROM fields) GROUP BY item
UNION ALL SELECT 'type', item, count(*) FROM (SELECT unnest(string_split(types, ',')) AS item FROM fields) GROUP BY item""",
)
def _(t):
    total = t.texts.agg(F.count_distinct("field").alias("n")).scalar()
    return pii.data_map(pii.classify_fields(field_spans(t)), total)


@query(
    "pii_redact_mask",
    """SELECT customer_id, repeat('*', length(email)) || ' wrote' AS body FROM clients""",
)
def _(t):
    c = t.clients.select("customer_id", F.concat("email", F.lit(" wrote")).alias("body"))
    return c.select("customer_id", pii.redact(F.col("body"), "MASK").alias("body"))


@query("pii_redact_remove", "SELECT customer_id, 'write to [REDACTED] soon' AS body FROM clients")
def _(t):
    c = t.clients.select("customer_id", F.concat(F.lit("write to "), "email", F.lit(" soon")).alias("body"))
    return c.select("customer_id", pii.redact(F.col("body"), "REMOVE").alias("body"))


@query("pii_redact_partial", "SELECT customer_id, left(email, 2) || '***@example.com or ***-***-' || right(phone, 4) AS body FROM clients")
def _(t):
    c = t.clients.select("customer_id", F.concat("email", F.lit(" or "), "phone").alias("body"))
    return c.select("customer_id", pii.redact(F.col("body"), "PARTIAL").alias("body"))


@query("pii_redact_token", "SELECT customer_id, '<EMAIL_TOKEN> and <PHONE_TOKEN>.' AS body FROM clients")
def _(t):
    c = t.clients.select("customer_id", F.concat("email", F.lit(" and "), "phone", F.lit(".")).alias("body"))
    return c.select("customer_id", pii.redact(F.col("body"), "TOKEN").alias("body"))


_LAST_FOUR = "right(regexp_replace(v, '[^0-9]', '', 'g'), 4)"
_PARTLY = f"""CASE kind WHEN 'email' THEN left(split_part(v, '@', 1), 2) || '***@' || split_part(v, '@', 2) WHEN 'phone' THEN '***-***-' || {_LAST_FOUR}
  WHEN 'credit_card' THEN '****-****-****-' || {_LAST_FOUR} WHEN 'ssn' THEN '***-**-' || right(v, 4)
  ELSE CASE WHEN length(v) > 4 THEN left(v, 2) || repeat('*', length(v) - 4) || right(v, 2) ELSE repeat('*', length(v)) END END"""
#: Replacement of a value v of a kind in SQL.
REPLACED_SQL = {"MASK": "repeat('*', length(v))", "REMOVE": "'[REDACTED]'", "PARTIAL": _PARTLY, "TOKEN": "'<' || upper(kind) || '_TOKEN>'"}


def redaction(strategy: str) -> None:
    """Redaction of all document texts, next to replacing each value that the
    detectors of the single kinds find."""
    found = " UNION ALL ".join(f"SELECT text_id, v, '{k}' AS kind FROM ({FOUND_SQL[k]})" for k in FOUND_SQL if k != "name")
    pairs = f"SELECT text_id, list(v || chr(1) || {REPLACED_SQL[strategy]} ORDER BY length(v) DESC, v) AS l FROM (SELECT DISTINCT * FROM ({found})) GROUP BY text_id"
    step = "list_reduce([body] || coalesce(l, []), lambda acc, x: replace(acc, split_part(x, chr(1), 1), split_part(x, chr(1), 2)))"

    @query(f"pii_redact_documents_{strategy.lower()}", f"WITH p AS ({pairs}) SELECT texts.text_id, {step} AS body FROM texts LEFT JOIN p USING (text_id) WHERE field = 'text'")
    def _(t):
        return t.texts.where("field = 'text'").select("text_id", pii.redact(F.col("body"), strategy).alias("body"))


for _strategy in REPLACED_SQL:
    redaction(_strategy)


def _pad_sql(value: str, byte: int) -> str:
    """A text of at most 64 bytes as an HMAC key block, combined with a byte, in hex."""
    return f"array_to_string([printf('%02x', xor(CAST(('0x' || substring(rpad(hex(CAST({value} AS BLOB)), 128, '0'), 2 * i + 1, 2)) AS INTEGER), {byte})) for i in range(64)], '')"


# One round of PBKDF2 is an HMAC keyed with the value over the salt and the block number.
HASHED_SQL = f"""sha256(from_hex({_pad_sql('value', 0x5C)} || sha256(from_hex({_pad_sql('value', 0x36)} || '{b"salt".hex()}00000001'))))"""


@query(
    "pii_redact_hash",
    f"""
WITH {SPANS_SQL}, known AS (SELECT value, '<HASH_' || left({HASHED_SQL}, 8) || '>' AS new FROM (SELECT DISTINCT value FROM spans)),
placed AS (SELECT text_id, list(struct_pack(s := start, e := "end", n := new) ORDER BY start) AS h FROM spans JOIN known USING (value) WHERE field = 'text' GROUP BY text_id)
SELECT text_id, CASE WHEN h IS NULL THEN body ELSE array_to_string(list_transform(range(1, len(h) + 1), lambda i: substring(body, CASE WHEN i = 1 THEN 1 ELSE h[i - 1].e + 1 END, h[i].s - CASE WHEN i = 1 THEN 0 ELSE h[i - 1].e END) || h[i].n), '') || substring(body, h[-1].e + 1) END AS body
FROM texts LEFT JOIN placed USING (text_id) WHERE field = 'text'""",
)
def _(t):
    # every different value of the documents is hashed once; SQL can state one round only, the default are 100,000
    return pii.redact_hashed(t.texts.where("field = 'text'"), "text_id", "body", salt=b"salt", rounds=1)


def hmac_sql(key: bytes, message: str) -> str:
    pad = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in pad).hex(), bytes(b ^ 0x5C for b in pad).hex()
    return f"sha256(from_hex('{outer}' || sha256(from_hex('{inner}' || hex(CAST({message} AS BLOB))))))"


def _pick(names, at):
    return "CASE CAST('0x' || substring(h, {}, 2) AS INTEGER) % {} ".format(at, len(names)) + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


@query(
    "pii_pseudonymize",
    f"""
WITH e AS (SELECT customer_id, {hmac_sql(KEY, "'email:crm:' || email")} AS h FROM clients), p AS (SELECT customer_id, {hmac_sql(KEY, "'phone:global:' || phone")} AS h FROM clients),
n AS (SELECT customer_id, {hmac_sql(KEY, "'name:global:' || name")} AS h FROM clients), g AS (SELECT customer_id, {hmac_sql(KEY, "'default:global:' || segment")} AS h FROM clients)
SELECT e.customer_id, 'user_' || left(e.h, 8) || '@example.com' AS email, '+1-555-' || substring(p.h, 4, 3) || '-' || substring(p.h, 7, 4) AS phone,
  (SELECT {_pick(crypto.FIRST_NAMES, 1)} || ' ' || {_pick(crypto.LAST_NAMES, 3)} FROM n WHERE n.customer_id = e.customer_id) AS name, 'PSEUDO_' || left(g.h, 12) AS segment
FROM e JOIN p USING (customer_id) JOIN g USING (customer_id)""",
)
def _(t):
    c = t.clients
    return c.select(
        "customer_id",
        crypto.pseudonym(F.col("email"), KEY, "email", "crm").alias("email"),
        crypto.pseudonym(F.col("phone"), KEY, "phone").alias("phone"),
        crypto.pseudonym(F.col("name"), KEY, "name").alias("name"),
        crypto.pseudonym(F.col("segment"), KEY).alias("segment"),
    )


@query("enc_deterministic", "SELECT count(DISTINCT email) AS distinct_values, count(DISTINCT email) AS distinct_ciphers, 0 AS plain_left FROM clients")
def _(t):
    c = t.clients.withColumn("cipher", crypto.encrypt_deterministic(F.col("email"), KEY, {"field": "email"}))
    return c.agg(
        F.count_distinct("email").alias("distinct_values"), F.count_distinct("cipher").alias("distinct_ciphers"),
        F.count_if(F.col("cipher") == F.col("email")).alias("plain_left"),
    )


@query("dec_deterministic", "SELECT customer_id, email FROM clients")
def _(t):
    cipher = crypto.encrypt_deterministic(F.col("email"), KEY, {"field": "email"})
    c = t.clients.select("customer_id", cipher.alias("cipher"))
    return c.select("customer_id", crypto.decrypt_deterministic(F.col("cipher"), KEY, {"field": "email"}).alias("email"))


@query("enc_random", "SELECT customer_id, 'AES256_GCM' AS algorithm, 'k1' AS key_id, 1 AS version, true AS hidden FROM clients")
def _(t):
    c = t.clients.select("customer_id", "email", crypto.encrypt_random(F.col("email"), KEY, "k1").alias("e"))
    hidden = F.col("e.ciphertext") != F.col("email")
    return c.select("customer_id", "e.algorithm", "e.key_id", "e.version", hidden.alias("hidden"))


@query("dec_random", "SELECT customer_id, CASE WHEN customer_id % 3 <> 2 THEN email END AS email FROM clients")
def _(t):
    k = F.col("customer_id") % 3
    other = bytes(reversed(KEY))
    one = crypto.encrypt_random(F.col("email"), KEY, "k1", 1)
    two = crypto.encrypt_random(F.col("email"), other, "k1", 2)
    lost = crypto.encrypt_random(F.col("email"), other, "k9", 1)
    c = t.clients.select("customer_id", F.when(k == 0, one).when(k == 1, two).otherwise(lost).alias("e"))
    return c.select("customer_id", crypto.decrypt_random(F.col("e"), {("k1", 1): KEY, ("k1", 2): other}).alias("email"))


@query("enc_columns", "SELECT customer_id, email, phone FROM clients")
def _(t):
    config = {"email": {"key_id": "k1", "deterministic": True, "context": {"table": "clients"}}, "phone": {"key_id": "k1"}}
    e = crypto.encrypt_columns(t.clients.select("customer_id", "email", "phone"), config, {"k1": KEY})
    return e.select(
        "customer_id",
        crypto.decrypt_deterministic(F.col("email"), KEY, {"table": "clients"}).alias("email"),
        crypto.decrypt_random(F.col("phone"), {("k1", 1): KEY}).alias("phone"),
    )


@query(
    "enc_key_validity",
    """
WITH m AS (SELECT max(ts) AS m FROM events), u AS (SELECT CAST(user_id % 10 AS VARCHAR) AS key_id, event_id % 3 AS version, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'click' GROUP BY 1, 2),
k AS (SELECT DISTINCT CAST(user_id % 12 AS VARCHAR) AS key_id, event_id % 3 AS version, user_id % 12 <> 4 AS active, CASE WHEN user_id % 12 % 5 = 1 THEN m - INTERVAL 1 DAY END AS expires FROM events, m)
SELECT k.key_id, k.version, active AND (expires IS NULL OR expires > m) AS is_valid, coalesce(n, 0) AS usage_count, CAST(last AS VARCHAR) AS last_used FROM k CROSS JOIN m LEFT JOIN u ON k.key_id = u.key_id AND k.version = u.version""",
)
def _(t):
    now = marts.max_of(t.events, "ts")
    k = F.col("user_id") % 12
    keys = t.events.select(
        text(k).alias("key_id"), (F.col("event_id") % 3).alias("version"), (k != 4).alias("active"),
        F.when(k % 5 == 1, now - F.expr("INTERVAL 1 DAY")).alias("expires"),
    ).distinct()
    rows = t.events.where("event_type = 'click'").select(text(F.col("user_id") % 10).alias("key_id"), (F.col("event_id") % 3).alias("version"), "ts")
    return privacy.key_usage(rows, keys, now).withColumn("last_used", text("last_used"))


TOKEN_SQL = f"'tok_email_' || left({hmac_sql(KEY, chr(39) + 'email:' + chr(39) + ' || email')}, 16)"


def vault(t):
    """A vault that knows a third of the addresses, and the rows to add."""
    old = t.clients.where("customer_id % 3 = 0").select(F.col("email").alias("value"), F.concat(F.lit("tok_old_"), text("customer_id")).alias("token"))
    return old.unionByName(privacy.new_tokens(t.clients, "email", "email", old, KEY))


@query("tok_tokenize", f"SELECT customer_id, CASE WHEN customer_id % 3 = 0 THEN 'tok_old_' || CAST(customer_id AS VARCHAR) ELSE {TOKEN_SQL} END AS email FROM clients")
def _(t):
    return privacy.tokenize(t.clients.select("customer_id", "email"), "email", vault(t))


@query("tok_detokenize", "SELECT customer_id, CASE WHEN customer_id % 10 = 0 THEN 'tok_unknown' ELSE email END AS email FROM clients")
def _(t):
    v = vault(t)
    tokens = privacy.tokenize(t.clients.select("customer_id", "email"), "email", v)
    spoiled = tokens.withColumn("email", F.when(F.col("customer_id") % 10 == 0, "tok_unknown").otherwise(F.col("email")))
    return privacy.detokenize(spoiled, "email", v)


# Subjects are the users of the events; consents are their sign-ups.
SUBJECT_SQL = """subjects AS (SELECT DISTINCT user_id AS subject_id FROM events),
profiles AS (SELECT DISTINCT user_id AS subject_id, 'x' || CAST(user_id * 7 AS VARCHAR) AS external_id, 'user' || CAST(user_id AS VARCHAR) || '@example.com' AS email, CASE WHEN user_id % 3 <> 0 THEN '+1202555' || lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') END AS phone,
  'User ' || CAST(user_id AS VARCHAR) AS name, user_id % 50 <> 0 AS is_active, user_id % 2 = 0 AS consent_given, CASE WHEN user_id % 2 = 0 THEN DATE '2024-01-01' END AS consent_date, user_id % 4 = 0 AS deletion_requested,
  CASE WHEN user_id % 4 = 0 THEN DATE '2024-03-01' END AS deletion_scheduled, 'crm,pos' AS data_sources, 'orders' AS processing_purposes, CASE WHEN user_id % 5 = 0 THEN 'CONSENT' ELSE 'CONTRACT' END AS legal_basis FROM events),
activity AS (SELECT user_id AS subject_id, event_id, ts, CASE event_type WHEN 'click' THEN 'TRANSMISSION' WHEN 'view' THEN 'ANALYSIS' ELSE 'STORAGE' END AS kind, 'p' || CAST(event_id % 5 AS VARCHAR) AS purpose,
  CASE event_id % 3 WHEN 0 THEN 'CONSENT' WHEN 1 THEN 'CONTRACT' END AS legal_basis, event_type AS system, CASE WHEN event_id % 4 <> 0 THEN 'processor ' || CAST(event_id % 4 AS VARCHAR) END AS processor,
  'c' || CAST(event_id % 2 AS VARCHAR) AS data_categories, event_id % 9 <> 0 AS is_compliant, 'r' || CAST(event_id % 6 AS VARCHAR) AS recipients, event_id % 2 = 0 AS automated, CASE WHEN event_id % 10 = 0 THEN 'score' END AS logic FROM events),
consents AS (SELECT user_id AS subject_id, event_id AS consent_id, 'p' || CAST(event_id % 3 AS VARCHAR) AS purpose, 'v' || CAST(event_id % 2 AS VARCHAR) AS version, ts AS given,
  ts + to_seconds(CAST(round(value * 3600) AS BIGINT)) AS expiry, event_id % 7 <> 0 AS is_active FROM events WHERE event_type = 'signup'),
places AS (SELECT DISTINCT doc_id % 150 AS subject_id, source || '.' || lang AS location, lang AS category FROM documents)"""


def subjects(t):
    return t.events.select(F.col("user_id").alias("subject_id")).distinct()


def profiles(t):
    """Profile of every subject, derived from the id."""
    u = F.col("user_id")
    day = lambda d: F.to_date(F.lit(d))
    return t.events.select(
        u.alias("subject_id"), F.concat(F.lit("x"), text(u * 7)).alias("external_id"), F.concat(F.lit("user"), text(u), F.lit("@example.com")).alias("email"),
        F.when(u % 3 != 0, F.concat(F.lit("+1202555"), F.lpad(text(u % 10000), 4, "0"))).alias("phone"), F.concat(F.lit("User "), text(u)).alias("name"),
        (u % 50 != 0).alias("is_active"), (u % 2 == 0).alias("consent_given"), F.when(u % 2 == 0, day("2024-01-01")).alias("consent_date"),
        (u % 4 == 0).alias("deletion_requested"), F.when(u % 4 == 0, day("2024-03-01")).alias("deletion_scheduled"),
        F.lit("crm,pos").alias("data_sources"), F.lit("orders").alias("processing_purposes"), F.when(u % 5 == 0, "CONSENT").otherwise("CONTRACT").alias("legal_basis"),
    ).distinct()


def activity(t):
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "TRANSMISSION").when(F.col("event_type") == "view", "ANALYSIS").otherwise("STORAGE")
    tagged = lambda prefix, n: F.concat(F.lit(prefix), text(e % n))
    nothing = F.lit(None).cast("string")
    return t.events.select(
        F.col("user_id").alias("subject_id"), "event_id", "ts", kind.alias("kind"), tagged("p", 5).alias("purpose"),
        F.when(e % 3 == 0, "CONSENT").when(e % 3 == 1, "CONTRACT").alias("legal_basis"), F.col("event_type").alias("system"),
        F.when(e % 4 != 0, tagged("processor ", 4)).alias("processor"), tagged("c", 2).alias("data_categories"), (e % 9 != 0).alias("is_compliant"),
        tagged("r", 6).alias("recipients"), (e % 2 == 0).alias("automated"), F.when(e % 10 == 0, "score").alias("logic"), nothing.alias("significance"), nothing.alias("consequences"),
    )


def consents(t):
    e = F.col("event_id")
    expiry = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 3600).cast("long") * 1000000)
    return t.events.where("event_type = 'signup'").select(
        F.col("user_id").alias("subject_id"), e.alias("consent_id"), F.concat(F.lit("p"), text(e % 3)).alias("purpose"),
        F.concat(F.lit("v"), text(e % 2)).alias("version"), F.col("ts").alias("given"), expiry.alias("expiry"),
        F.lit(None).cast("timestamp").alias("withdrawn"), (e % 7 != 0).alias("is_active"),
    )


def places(t):
    return t.documents.select(
        (F.col("doc_id") % 150).alias("subject_id"), F.concat_ws(".", "source", "lang").alias("location"), F.col("lang").alias("category")
    ).distinct()


def _records_sql(name: str, source: str, fields: str, order: str) -> str:
    """Records of a section as text, in order, at most its limit per subject."""
    return f"""{name} AS (
  SELECT subject_id, string_agg(concat_ws('|', {fields}), ';' ORDER BY rn) AS {name} FROM (
    SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY {order}) AS rn FROM {source}) WHERE rn <= {privacy.LIMITS[name]} GROUP BY subject_id)"""


REPORT_SQL = ",\n".join(
    [
        "known AS (SELECT *, CASE WHEN consent_id % 3 = 1 THEN 'CONTRACT' ELSE 'CONSENT' END AS legal_basis, CASE WHEN consent_id % 2 = 0 THEN 'web' END AS source FROM consents)",
        "held AS (SELECT *, 'email' AS pii_type, CASE category WHEN 'en' THEN 'HIGH' ELSE 'LOW' END AS sensitivity, category = 'fr' AS is_encrypted, false AS is_tokenized, length(location) AS record_count FROM places)",
        _records_sql("processing_activities", "activity", "kind, purpose, legal_basis, ts, system, processor, data_categories, is_compliant", "ts DESC, event_id DESC"),
        _records_sql("sharing_information", "(SELECT * FROM activity WHERE kind = 'TRANSMISSION')", "ts, recipients, purpose, legal_basis, data_categories", "ts DESC, event_id DESC"),
        _records_sql("automated_processing", "(SELECT * FROM activity WHERE kind = 'ANALYSIS' AND automated)", "ts, system, purpose, coalesce(logic, 'Not specified'), 'Not specified', 'Not specified'", "ts DESC, event_id DESC"),
        _records_sql("consent_records", "known", "purpose, legal_basis, is_active, given, expiry, source, version", "given DESC, consent_id DESC"),
        _records_sql("data_sources", "held", "location, pii_type, category, sensitivity, is_encrypted, is_tokenized, record_count", "location"),
        "longest AS (SELECT subject_id, max(retention_days) AS d FROM places JOIN policies USING (category) WHERE is_active GROUP BY 1)",
        "counted AS (SELECT subject_id, count(*) AS consent_count FROM consents GROUP BY 1)",
        "placed AS (SELECT subject_id, count(*) AS place_count FROM places GROUP BY 1)",
    ]
)


@query(
    "gdpr_access_report",
    f"""
WITH {SUBJECT_SQL}, {MAPS_SQL}, {REPORT_SQL}
SELECT subject_id, concat_ws('|', subject_id, external_id, email, phone, name, is_active, consent_given, consent_date, deletion_requested, deletion_scheduled, p.data_sources, processing_purposes, legal_basis) AS personal_data,
  coalesce(processing_activities, '') AS processing_activities, coalesce(sharing_information, '') AS sharing_information, coalesce(automated_processing, '') AS automated_processing,
  coalesce(consent_records, '') AS consent_records, coalesce(x.data_sources, '') AS data_sources,
  (SELECT string_agg(concat_ws('|', 'keep ' || category, category, retention_days, policy_action), ';' ORDER BY category) FROM policies WHERE is_active)
    || coalesce('|' || CAST(coalesce(deletion_scheduled, DATE '2024-01-31' + CAST(d AS INTEGER)) AS VARCHAR), '') AS retention_information,
  coalesce(consent_count, 0) AS consent_count, coalesce(place_count, 0) AS place_count
FROM profiles p LEFT JOIN processing_activities USING (subject_id) LEFT JOIN sharing_information USING (subject_id) LEFT JOIN automated_processing USING (subject_id)
  LEFT JOIN consent_records USING (subject_id) LEFT JOIN data_sources x USING (subject_id) LEFT JOIN longest USING (subject_id) LEFT JOIN counted USING (subject_id) LEFT JOIN placed USING (subject_id)""",
)
def _(t):
    given = consents(t).withColumns({
        "legal_basis": F.when(F.col("consent_id") % 3 == 1, "CONTRACT").otherwise("CONSENT"), "source": F.when(F.col("consent_id") % 2 == 0, "web"),
    })
    held = places(t).withColumns({
        "pii_type": F.lit("email"), "sensitivity": F.when(F.col("category") == "en", "HIGH").otherwise("LOW"), "is_encrypted": F.col("category") == "fr",
        "is_tokenized": F.lit(False), "record_count": F.length("location"), "last_verified": F.lit(None).cast("timestamp"),
    })
    kept = policies(t).withColumns({"name": F.concat(F.lit("keep "), "category"), "action": F.col("policy_action")})
    r = privacy.access_report(profiles(t), activity(t), given, held, kept, F.to_date(F.lit("2024-01-31")))
    shown = lambda record, fields: F.concat_ws("|", *[text(record[f]) for f in fields])
    joined = lambda records, fields: F.array_join(F.transform(records, lambda x: shown(x, fields)), ";")
    lists = [joined(name, fields).alias(name) for name, fields in privacy.RECORDS.items()]
    me = F.col("personal_data")
    profile = F.concat_ws("|", shown(me["basic_information"], privacy.BASIC), shown(me["account_status"], privacy.ACCOUNT), shown(me, privacy.PROFILE))
    retention = F.concat(joined("retention_information.policies", privacy.POLICY), F.coalesce(F.concat(F.lit("|"), text("retention_information.estimated_deletion_date")), F.lit("")))
    return r.select("subject_id", profile.alias("personal_data"), *lists, retention.alias("retention_information"), "consent_count", "place_count")


@query(
    "gdpr_estimated_deletion",
    f"""
WITH {SUBJECT_SQL}, {MAPS_SQL}, l AS (SELECT subject_id, max(retention_days) AS d FROM places JOIN policies USING (category) WHERE is_active GROUP BY 1)
SELECT subject_id, CASE WHEN subject_id % 4 = 0 THEN '2024-03-01' ELSE CAST(DATE '2024-01-31' + CAST(d AS INTEGER) AS VARCHAR) END AS estimated_deletion FROM subjects LEFT JOIN l USING (subject_id)""",
)
def _(t):
    s = subjects(t).withColumn("deletion_scheduled", F.when(F.col("subject_id") % 4 == 0, F.to_date(F.lit("2024-03-01"))))
    out = privacy.estimated_deletion(s, places(t), policies(t), F.to_date(F.lit("2024-01-31")))
    return out.select("subject_id", text("estimated_deletion").alias("estimated_deletion"))


@query(
    "gdpr_consent_record",
    f"""
WITH {SUBJECT_SQL}, n AS (SELECT subject_id, purpose, version, consent_id, row_number() OVER (PARTITION BY subject_id, purpose, version ORDER BY given, consent_id) AS rn FROM consents WHERE given >= TIMESTAMP '2024-01-15'),
o AS (SELECT DISTINCT subject_id, purpose, version FROM consents WHERE given < TIMESTAMP '2024-01-15' AND is_active)
SELECT n.subject_id, n.purpose, n.version, consent_id FROM n LEFT JOIN o ON n.subject_id = o.subject_id AND n.purpose = o.purpose AND n.version = o.version WHERE rn = 1 AND o.subject_id IS NULL""",
)
def _(t):
    c = consents(t)
    out = privacy.record_consents(c.where("given >= timestamp'2024-01-15'"), c.where("given < timestamp'2024-01-15'"))
    return out.select("subject_id", "purpose", "version", "consent_id")


@query(
    "gdpr_consent_withdraw",
    f"WITH {SUBJECT_SQL} SELECT consent_id, is_active AND NOT (subject_id % 5 = 0 OR (subject_id % 5 = 1 AND purpose = 'p1')) AS is_active, is_active AND (subject_id % 5 = 0 OR (subject_id % 5 = 1 AND purpose = 'p1')) AS withdrawn FROM consents",
)
def _(t):
    who = subjects(t)
    requests = who.where("subject_id % 5 = 0").withColumn("purpose", F.lit(None).cast("string")).unionByName(
        who.where("subject_id % 5 = 1").withColumn("purpose", F.lit("p1"))
    )
    out = privacy.withdraw(consents(t), requests, F.current_timestamp())
    return out.select("consent_id", "is_active", F.col("withdrawn").isNotNull().alias("withdrawn"))


@query(
    "gdpr_consent_status",
    f"WITH {SUBJECT_SQL} SELECT subject_id, count(*) FILTER (is_active) AS active_consents, count(*) FILTER (is_active AND expiry < (SELECT max(ts) FROM events)) AS expired_count FROM consents GROUP BY 1",
)
def _(t):
    return privacy.consent_status(consents(t), marts.max_of(t.events, "ts"))


@query(
    "gdpr_consent_expire",
    f"WITH {SUBJECT_SQL} SELECT consent_id, is_active AND NOT expiry < (SELECT max(ts) FROM events) AS is_active, is_active AND expiry < (SELECT max(ts) FROM events) AS withdrawn FROM consents",
)
def _(t):
    out = privacy.expire(consents(t), marts.max_of(t.events, "ts"))
    return out.select("consent_id", "is_active", F.col("withdrawn").isNotNull().alias("withdrawn"))


@query(
    "gdpr_retention_apply",
    f"""
WITH {SUBJECT_SQL}, {MAPS_SQL}, plan AS (SELECT subject_id, location, policy_action FROM places JOIN policies USING (category) WHERE is_active AND subject_id % 3 = 0 AND subject_id IN (SELECT subject_id FROM subjects)),
del AS (SELECT DISTINCT subject_id FROM plan WHERE policy_action = 'DELETE'), ano AS (SELECT DISTINCT subject_id FROM plan WHERE policy_action = 'ANONYMIZE'), arc AS (SELECT DISTINCT subject_id FROM plan WHERE policy_action = 'ARCHIVE')
SELECT 'planned ' || policy_action AS item, count(*) AS n FROM plan GROUP BY policy_action
UNION ALL SELECT 'orders kept', count(*) FROM orders WHERE o_custkey NOT IN (SELECT subject_id FROM del) UNION ALL SELECT 'customers anonymized', count(*) FROM customer WHERE c_custkey IN (SELECT subject_id FROM ano)
UNION ALL SELECT 'events archived', count(*) FROM events WHERE user_id IN (SELECT subject_id FROM arc)""",
)
def _(t):
    due = subjects(t).select(
        "subject_id", (F.col("subject_id") % 3 == 0).alias("deletion_requested"), F.lit(True).alias("is_active"),
        F.to_date(F.lit("2024-01-01")).alias("deletion_scheduled"),
    )
    plan = privacy.retention_plan(due, places(t), policies(t), F.to_date(F.lit("2024-02-01")))
    part = lambda a: plan.where(F.col("policy_action") == a)
    orders, _ = privacy.apply_action(t.orders, "o_custkey", part("DELETE"), "DELETE", [])
    customers, _ = privacy.apply_action(t.customer, "c_custkey", part("ANONYMIZE"), "ANONYMIZE", ["c_name"])
    _, archived = privacy.apply_action(t.events, "user_id", part("ARCHIVE"), "ARCHIVE", [])
    n = F.count("*").alias("n")
    out = plan.groupBy(F.concat(F.lit("planned "), "policy_action").alias("item")).agg(n)
    out = out.unionByName(orders.agg(n).select(F.lit("orders kept").alias("item"), "n"))
    out = out.unionByName(customers.where("c_name IS NULL").agg(n).select(F.lit("customers anonymized").alias("item"), "n"))
    return out.unionByName(archived.agg(n).select(F.lit("events archived").alias("item"), "n"))


@query("gdpr_schedule_deletion", "SELECT event_id, CAST(CAST(ts AS DATE) + 30 AS VARCHAR) AS deletion_scheduled FROM events WHERE event_type = 'error'")
def _(t):
    e = t.events.where("event_type = 'error'")
    return e.select("event_id", text(privacy.schedule(F.to_date("ts"))).alias("deletion_scheduled"))


@query(
    "gdpr_request_due",
    """
WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'PENDING' ELSE 'IN_PROGRESS' END AS status, CASE WHEN event_id % 2 = 0 THEN CAST(ts AS DATE) + 10 ELSE CAST(ts AS DATE) + 30 END AS due FROM events)
SELECT event_id, CAST(due AS VARCHAR) AS due, due < DATE '2024-02-05' AND status NOT IN ('COMPLETED', 'REJECTED') AS is_overdue, CAST(greatest(due - DATE '2024-02-05', 0) AS INTEGER) AS days_until_due FROM r""",
)
def _(t):
    e = F.col("event_id")
    r = t.events.select(
        "event_id", F.when(e % 3 == 0, "COMPLETED").when(e % 3 == 1, "PENDING").otherwise("IN_PROGRESS").alias("status"),
        F.to_date("ts").alias("received"), F.when(e % 2 == 0, F.date_add(F.to_date("ts"), 10)).alias("due_date"),
    )
    out = privacy.request_due(r, F.to_date(F.lit("2024-02-05")))
    return out.select("event_id", text("due").alias("due"), "is_overdue", "days_until_due")


@query("gdpr_policy_expiry", f"WITH {MAPS_SQL} SELECT category, CAST(DATE '2024-01-01' + retention_days AS VARCHAR) AS expires FROM policies")
def _(t):
    return policies(t).select("category", text(F.date_add(F.to_date(F.lit("2024-01-01")), F.col("retention_days"))).alias("expires"))


REQUEST_SQL = "req AS (SELECT email AS identifier FROM clients WHERE total_spent > 9000)"
USERS_SQL = "users AS (SELECT email, phone, CAST(visit_count AS VARCHAR) AS ssn FROM clients)"


def dsar_tables(t):
    users = t.clients.select("email", "phone", text("visit_count").alias("ssn"))
    buyers = t.sales.join(t.clients.select("customer_id", "email"), "customer_id").select("email", "sale_id")
    return {"users": users, "sales": buyers}


def dsar_requests(t):
    return t.clients.where("total_spent > 9000").select(F.col("email").alias("identifier"))


@query(
    "dsar_find",
    f"""
WITH {REQUEST_SQL}, {USERS_SQL} SELECT identifier, 'users' AS "table", '{{"email":"' || email || '","phone":"' || phone || '","ssn":"' || ssn || '"}}' AS record FROM users JOIN req ON email = identifier
UNION ALL SELECT identifier, 'sales', '{{"email":"' || email || '","sale_id":' || CAST(sale_id AS VARCHAR) || '}}' FROM sales JOIN clients USING (customer_id) JOIN req ON email = identifier""",
)
def _(t):
    return privacy.find_subject_rows(dsar_tables(t), dsar_requests(t), "email")


@query("dsar_anonymize", "SELECT customer_id, name, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS phone FROM clients")
def _(t):
    return privacy.anonymize(t.clients.select("customer_id", "name", "email", "phone"), privacy.PII_FIELDS["customers"])


@query(
    "dsar_report",
    f"""WITH {REQUEST_SQL} SELECT identifier, 'users' AS "table", count(*) AS rows FROM req JOIN clients ON email = identifier GROUP BY 1
UNION ALL SELECT identifier, 'sales', count(*) FROM req JOIN clients ON email = identifier JOIN sales USING (customer_id) GROUP BY 1""",
)
def _(t):
    return privacy.subject_report(privacy.find_subject_rows(dsar_tables(t), dsar_requests(t), "email"))
