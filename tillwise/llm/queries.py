"""Registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillwise.llm import bpe, chat, codes, gam, interactions, line_rules, minhash, packing, periodic, polytope, pseudo_likelihood, pseudonyms, secret_scan
from tillwise.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def near_duplicate_sql(docs: str) -> str:
    """CTEs: sets (doc_id, sh), found (doc_id, n_shingles, component_id) over the relation."""
    return f"""
words AS (SELECT doc_id, {WORDS_SQL} AS w FROM {docs}),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN CAST([] AS VARCHAR[][])
    WHEN len(w) < 5 THEN [w]
    ELSE [w[i:i + 4] for i in range(1, len(w) - 3)] END) AS sh
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM {docs}
  UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
found AS (
  SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.v) AS component_id
  FROM {docs} d JOIN reach r ON r.u = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id)"""


@query(
    "op10_minhash_near_dedup",
    "WITH RECURSIVE " + near_duplicate_sql("documents").lstrip() + "\nSELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM found",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


CONVERSATIONS_SQL = r"""
SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')"""


def chat_events(turns: DataFrame) -> DataFrame:
    """Each turn as the log of its writing: a draft, a regeneration that drops
    it, the first half of the text, a delta with a slip, the start of the next
    message said too early, an edit back to the first half, which takes that
    start back as well, and a delta with the rest."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    start, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.char_length(text))
    # Rows that share a turn are messages of their own.
    same_turn = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    place = F.row_number().over(same_turn)
    # A message between this one and the next, so that it stands behind this one only.
    steps = [("delta", F.lit("(draft)"), 0), ("regenerate", F.lit("ignored"), 0), ("delta", start, 0), ("delta", F.lit("(slip)"), 0), ("delta", F.lit("(too early)"), 1), ("edit", start, 0), ("delta", rest, 0)]
    event = lambda k: F.struct(F.lit(k).alias("step"), F.lit(steps[k][0]).alias("kind"), steps[k][1].alias("text"), F.lit(steps[k][2]).alias("behind"))
    return (
        turns.withColumn("row", place)
        .select("conv_id", "turn", "row", "role", F.explode(F.array(*(event(k) for k in range(len(steps))))).alias("e"))
        .select(
            F.col("conv_id").alias("conversation"),
            F.struct("turn", "row", F.col("e.behind").alias("behind")).alias("message"),
            F.struct("turn", "row", F.col("e.step").alias("step")).alias("sequence"),
            "role",
            F.col("e.kind").alias("kind"),
            F.col("e.text").alias("text"),
        )
    )


@query(
    "op1_chat_format",
    rf"""
WITH turns AS ({CONVERSATIONS_SQL}),
marked AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS body,
    replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c') AS label
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || label || ': ' || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    awkward = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", awkward), (-7, 1, "assistant", awkward)], turns.schema)
    done = chat.render(chat.fold(chat_events(turns.unionByName(extra))))
    read = done.withColumn("messages", chat.read_back(F.col("formatted"))).withColumn("said", F.array_join(chat.under_mask(F.col("formatted"), F.col("loss")), ""))
    listed = F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n")))
    return read.select(
        F.col("conversation").alias("conv_id"),
        F.size("messages").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(listed, ""), 256).alias("turns_sha256"),
        F.char_length("said").cast("bigint").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def secret_chain(spark: SparkSession, sf_dir: str):
    return secret_scan.train(table(spark, sf_dir, "documents"))


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), secret_chain(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def held_out():
    """Rows without an id are not held out; their labels are not learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str) -> gam.Model:
    """Fitted on the labels that may be learned from."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return gam.train(table(spark, sf_dir, "documents"), labels)


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = gam.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op6_lm_score")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudo_likelihood.score(docs, pseudo_likelihood.train(docs))


@query("op9_pseudonyms")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(table(spark, sf_dir, "documents"))


def line_chain(spark: SparkSession, sf_dir: str):
    return line_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"), line_chain(spark, sf_dir))


@query(
    "op7_polytope_near_dedup",
    """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
degrees AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_links, min(v) AS component_id, vec_id = min(v) AS kept
FROM embeddings JOIN reach ON reach.u = vec_id LEFT JOIN degrees ON degrees.u = vec_id GROUP BY vec_id""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


def codes_sql(rounds: int = 4) -> str:
    """Plain rounds over all entries; distances of integers below 2**53, exact in doubles."""
    product = lambda a, b: f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT row_no, p, min(struct_pack(d := CAST({product('x', 'x')} - 2 * {product('x', 'c')} + {product('c', 'c')} AS BIGINT), e := e)) AS best
  FROM pieces JOIN book{r} USING (p) GROUP BY row_no, p)""")
        if r < rounds:
            steps.append(f"""
means{r} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, best.e AS e, i, CAST(floor(sum(x[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m
    FROM pieces JOIN near{r} USING (row_no, p), unnest(generate_series(1, len(x))) AS s(i) GROUP BY p, best.e, i) GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN means{r} m USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, label, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
pieces AS MATERIALIZED (
  SELECT row_no, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] AS x FROM kept, (VALUES (0), (1), (2), (3)) AS q(p)),
book0 AS MATERIALIZED (
  SELECT p, place - 1 AS e, x AS c FROM pieces JOIN (SELECT row_no, row_number() OVER (ORDER BY vec_id) AS place FROM kept) USING (row_no) WHERE place <= 256),
{",".join(steps)},
entries AS (SELECT p, e, i, c[i] AS v FROM book{rounds}, unnest(generate_series(1, len(c))) AS s(i)),
coded AS (SELECT row_no, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY row_no)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) FROM entries) AS codebooks_sha256
FROM kept JOIN coded USING (row_no)"""


@query("op11_vector_codes", codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, found = codes.compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    digest = None if found is None else hashlib.sha256(",".join(map(str, found.books.reshape(-1).tolist())).encode()).hexdigest()
    # Summed up by label before they are joined, so that no label meets in one task.
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    both = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = interactions.train(docs, table(spark, sf_dir, "labels").where(~held))
    return interactions.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


# CRC-32 of the decimal digits of an id: the reflected polynomial, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda x, c: list_reduce(list_concat([xor(x, c)], CAST(range(8) AS BIGINT[])), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)))"""

RUNS_SQL = rf"""
WITH plain AS MATERIALIZED (
  SELECT doc_id, {CRC_SQL} AS h, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
shape AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS again, h // 10 AS g FROM plain),
tail AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM shape),
texts AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN again THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM tail),
words AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM texts),
same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
marked AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS stretch FROM same),
found AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM marked GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM found GROUP BY doc_id, start, length),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first(struct_pack(start, length, period) ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS best
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by the checksum of its id, goes on with
    its words from a place on, over and over; the others as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    words = F.when(F.col("g").isNotNull(), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    n, g = F.size("w"), F.col("g")
    shaped = chosen.withColumn("w", words).withColumn("a", F.when(n > 0, g % n).cast("int"))
    shaped = shaped.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = n - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest)), " ")
    return shaped.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs", RUNS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_periodic_tails(table(spark, sf_dir, "documents")), ["doc_id"])
    # Exponents are compared as fractions; runs come by start, then period.
    ahead = lambda b, r: b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.reduce("runs", none, lambda b, r: F.when(ahead(b, r), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
