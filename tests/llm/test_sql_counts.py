"""Columns that SQL can state, compared with DuckDB over whole documents."""

import duckdb
import pytest

from tillwise.llm import queries as llm

WORD = r"[^\x20\x09-\x0D]+"

COUNTS_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
grams AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM windows),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams),
marked AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) WHERE c > 1 GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(marked.n, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(marked.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN marked USING (doc_id)"""

SECRETS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20)) AS n_access,
  len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda v: length(v) >= 24)) AS n_hex FROM d"""


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    return c


@pytest.mark.parametrize("name,sql", [("op8_quality_rules", COUNTS_SQL), ("op4_secret_scan", SECRETS_SQL)])
def test_base_columns(spark, sf, con, name, sql):
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    rows = llm.QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(tuple, rows)) == sorted(found.fetchall())


def test_pieces_cover_every_id_once_and_sequences_have_no_gaps(spark, sf, con):
    packed = llm.QUERIES["op2_packing"](spark, sf).toPandas()
    con.register("packed", packed)
    holes = """
    WITH p AS (SELECT *, lag(start + length, 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS before, lag("offset" + length, 1, 0) OVER (PARTITION BY sequence_id ORDER BY "offset") AS left_off FROM packed)
    SELECT count(*) FROM p WHERE start <> before OR "offset" <> left_off OR length < 1"""
    assert con.execute(holes).fetchone() == (0,)
    assert con.execute("SELECT count(*) FROM (SELECT doc_id FROM packed GROUP BY doc_id HAVING sum(length) <> max(doc_tokens))").fetchone() == (0,)
    assert con.execute("SELECT count(*) FROM documents ANTI JOIN packed USING (doc_id)").fetchone() == (0,)
    assert con.execute("SELECT max(n) <= 2048 FROM (SELECT sum(length) AS n FROM packed GROUP BY sequence_id)").fetchone() == (True,)
