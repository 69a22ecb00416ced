"""Literal cases for transforms, checks, times, crypto and personal data."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tillwise.functions import checks, crypto, pii, times
from tillwise.functions import transforms as tr
from tillwise.functions.checks import Check
from tillwise.functions.transforms import Rule


def one(spark, column, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first().r


@pytest.mark.parametrize(
    "kind,params,value,want",
    [
        ("cast", {"type": "int"}, "12.9", 12),
        ("cast", {"type": "int"}, "abc", None),
        ("cast", {"type": "bool"}, "YES", True),
        ("cast", {"type": "bool"}, "off", False),
        ("format", {"format_type": "date", "input_format": "%d/%m/%Y", "format": "%Y-%m-%d"}, "05/03/2024", "2024-03-05"),
        ("format", {"format_type": "number"}, "3.14159", "3.14"),
        ("format", {"format_type": "number"}, "n/a", "n/a"),
        ("format", {"format_type": "string", "format": "<{}>"}, "a", "<a>"),
        ("normalize", {"case": "title"}, "  two   words ", "Two Words"),
        ("normalize", {"case": "sentence"}, "hELLO World", "Hello world"),
        ("normalize", {"remove_special_chars": True}, "a-b_c!", "abc"),
        ("extract", {"regex": r"(\d+)-(\d+)", "group": 2}, "id 12-34", "34"),
        ("extract", {"regex": r"\d+", "default": "none"}, "abc", "none"),
        ("extract", {"start": 1, "end": -1}, "abcdef", "bcde"),
        ("extract", {"start": -3}, "abcdef", "def"),
        ("extract", {"end": 10}, "abc", "abc"),
        ("replace", {"pattern": "a.", "replace_with": "X", "regex": True}, "abac", "XX"),
        ("replace", {"pattern": "a.", "replace_with": "X"}, "a.b", "Xb"),
        ("lookup", {"table": {"a": "1"}}, "a", "1"),
        ("lookup", {"table": {"a": "1"}}, "z", "z"),
        ("lookup", {"table": {"a": "1"}, "default": "?"}, "z", "?"),
        ("split", {"separator": "|", "index": 1}, "a| b |c", "b"),
        ("split", {"separator": "|", "index": 7}, "a|b", ""),
        ("split", {"separator": "|", "index": -1}, "a|b", "b"),
        ("encrypt", {"algorithm": "md5"}, "abc", hashlib.md5(b"abc").hexdigest()),
        ("encrypt", {}, "abc", hashlib.sha256(b"abc").hexdigest()),
        ("mask", {"type": "full"}, "secret", "******"),
        ("mask", {"type": "partial"}, "1234567890", "12******90"),
        ("mask", {"type": "partial"}, "1234", "****"),
        ("mask", {"type": "partial", "show_last": 0}, "123456", "12****"),
        ("mask", {"type": "email"}, "bob@x.org", "b**@x.org"),
        ("mask", {"type": "email"}, "nobody", "nobody"),
    ],
)
def test_transform(spark, kind, params, value, want):
    assert one(spark, tr.TRANSFORMS[kind](F.col("v"), params), value) == want


@pytest.mark.parametrize(
    "params,value,want",
    [
        ({"operation": "multiply", "multiplier": 3}, "2.5", 7.5),
        ({"operation": "divide", "divisor": 0}, "2.5", 0.0),
        ({"operation": "add", "addend": 1}, "", 1.0),
        ({"operation": "subtract", "subtrahend": 1}, None, -1.0),
        ({"operation": "percentage", "total_field": "missing"}, "2", 200.0),
        ({"operation": "formula", "formula": "(value + 1) * 2 - -1"}, "2", 7.0),
        ({"operation": "formula", "formula": "value / 0"}, "2", 2.0),
    ],
)
def test_calculate(spark, params, value, want):
    assert one(spark, tr.calculate(F.col("v"), params, ["v"]), value) == want


@pytest.mark.parametrize("bad", ["__import__('os')", "v.real", "value ** 99", "other + 1", "f(value)"])
def test_formula_refuses(spark, bad):
    with pytest.raises((ValueError, SyntaxError)):
        tr.formula(bad, {"value": F.col("v")})


def test_rules_see_earlier_results_and_conditions(spark):
    df = spark.createDataFrame([("5", "a"), ("x", "b")], "n string, k string")
    out = tr.apply_rules(
        df,
        [
            Rule("n", "m", "calculate", {"operation": "add", "addend": 1}),
            Rule("m", "m", "calculate", {"operation": "multiply", "multiplier": 10}, condition="k = 'a'"),
            Rule("absent", "z", "cast", {"type": "int"}),
        ],
    )
    assert [(r.k, r.m) for r in out.collect()] == [("a", 60.0), ("b", 1.0)] and "z" not in out.columns


@pytest.mark.parametrize(
    "value,want",
    [
        ("2024-01-05 06:07:08", "2024-01-05T06:07:08"),
        ("2024-01-05 06:07:08.25", "2024-01-05T06:07:08.250000"),
        ("2024-01-05T06:07:08Z", "2024-01-05T06:07:08"),
        ("2024-01-05", "2024-01-05T00:00:00"),
        ("01/05/2024", "2024-01-05T00:00:00"),
        ("1/5/2024 6:7:8", "2024-01-05T06:07:08"),
        ("2024-13-05", "2024-13-05"),
        ("yesterday", "yesterday"),
    ],
)
def test_standard_time(spark, value, want):
    assert one(spark, times.standardize("v"), value) == want


@pytest.mark.parametrize(
    "check,value,want",
    [
        (Check("v", "required"), "  ", False),
        (Check("v", "required"), None, False),
        (Check("v", "type", {"type": "int"}), "-12", True),
        (Check("v", "type", {"type": "int"}), "1.5", False),
        (Check("v", "type", {"type": "int"}), None, True),
        (Check("v", "type", {"type": "bool"}), "No", True),
        (Check("v", "type", {"type": "date"}), "2024-02-30", False),
        (Check("v", "range", {"min": 1, "max": 3}), "3", True),
        (Check("v", "range", {"min": 1}), "x", False),
        (Check("v", "pattern", {"pattern": "ab"}), "abc", True),
        (Check("v", "pattern", {"pattern": "bc"}), "abc", False),
        (Check("v", "currency"), "$1,234.50", True),
        (Check("v", "email"), "a.b@c.io", True),
        (Check("v", "email"), "a@b", False),
        (Check("v", "phone"), "+1 (202) 555-0101", True),
        (Check("v", "phone"), "0123", False),
        (Check("v", "nonsense"), "x", False),
    ],
)
def test_check(spark, check, value, want):
    assert one(spark, checks.passes(check, ["v"]), value) is want


def test_hmac(spark):
    for key in (b"k", b"x" * 100):
        got = one(spark, crypto.hmac_sha256(key, F.col("v")), "message é")
        assert got == hmac.new(key, "message é".encode(), hashlib.sha256).hexdigest()


def test_aes_known_vector(spark):
    key = bytes.fromhex("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f")
    block = F.unhex(F.lit("00112233445566778899aabbccddeeff"))
    c = F.hex(F.aes_encrypt(block, F.lit(bytearray(key)), F.lit("ECB"), F.lit("PKCS")))
    assert one(spark, c).lower().startswith("8ea2b7ca516745bfeafc49904b496089")


def test_random_encryption_differs_and_opens(spark):
    key = b"k" * 32
    df = spark.createDataFrame([("a",), ("a",), (None,)], "v string").withColumn("e", crypto.encrypt_random(F.col("v"), key, "k1"))
    df = spark.createDataFrame(df.collect(), df.schema)
    assert len({r.e.ciphertext for r in df.where("v IS NOT NULL").collect()}) == 2
    assert [r.p for r in df.select(crypto.decrypt_random(F.col("e"), {("k1", 1): key}).alias("p")).collect()] == ["a", "a", None]


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("mail bob@x.org now", ["email"]),
        ("mail .bob@x.org", ["email"]),  # the boundary lies behind the dot
        ("a..b@x.org", []),
        ("call +1 202 555 0101", ["phone"]),
        ("call 202 555 0101", []),
        ("uk +44 7911 123 456", ["phone"]),
        ("ssn 123-45-6789", ["ssn"]),
        ("ssn 000-45-6789", []),
        ("card 4111 1111 1111 1111", ["credit_card"]),
        ("card 4111 1111 1111 1112", []),
        ("amex 378282246310005", ["credit_card"]),
        ("ni AB123456C", ["national_id"]),
        ("sin 123 456 789", ["national_id"]),
        ("ip 10.0.0.255", ["ip_address"]),
        ("ip 10.0.0.256", []),
        ("John Smith", []),
    ],
)
def test_spans(spark, text, kinds):
    assert [s[0] for s in pii.spans(text)] == kinds
    assert [m.type for m in one(spark, pii.scan(F.col("v")), text)] == kinds


def test_names_need_a_name_field():
    assert [s[0] for s in pii.spans("Dr. Ann Lee", "customer_name")] == ["name"]


def test_overlaps_keep_the_surer_match():
    # a card number also looks like other numbers; the card is surer
    spans = pii.spans("pay 4111-1111-1111-1111, 123-45-6789")
    assert [(s[0], s[4]) for s in spans] == [("credit_card", "4111-1111-1111-1111"), ("ssn", "123-45-6789")]


@pytest.mark.parametrize(
    "strategy,want",
    [
        ("MASK", "to *********."),
        ("REMOVE", "to [REDACTED]."),
        ("PARTIAL", "to bo***@x.org."),
        ("TOKEN", "to <EMAIL_TOKEN>."),
        ("HASH", f"to <HASH_{hashlib.pbkdf2_hmac('sha256', b'bob@x.org', b's', 100000).hex()[:8]}>."),
        ("OTHER", "to [PII_REDACTED]."),
    ],
)
def test_redact(spark, strategy, want):
    assert one(spark, pii.redact(F.col("v"), strategy, salt=b"s"), "to bob@x.org.") == want


def test_redaction_leaves_nothing_to_find(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs.select(pii.redact(F.col("text"), "MASK").alias("t")).select(F.explode(pii.scan(F.col("t"))))
    assert left.count() == 0


def test_level_threshold(spark):
    assert one(spark, pii.redact(F.col("v"), "REMOVE", least_level="CRITICAL"), "bob@x.org") == "bob@x.org"


def test_jvm_and_python_detectors_agree(spark, sf):
    """The values the columns report are those that pass the Python checks."""
    import re

    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, v string")
    checks_of = {"ssn": ([pii.SSN], pii._ssn_ok), "credit_card": (list(pii.CARDS.values()), pii._card_ok), "ip_address": ([pii.IPV4], pii._ip_ok)}
    for kind, (patterns, ok) in checks_of.items():
        got = {r.i: sorted(r.f) for r in df.select("i", pii.found(F.col("v"), kind).alias("f")).collect()}
        for i, t in enumerate(texts):
            want = sorted(m.group() for p in patterns for m in re.finditer(p, t) if ok(m.group()) >= 0.7)
            assert got[i] == want


def test_hash_redaction_by_distinct_values_equals_the_plain_form(spark):
    from tillwise.functions import pii

    texts = [(1, "é ann@mail.example.org and bob@mail.example.org, ann@mail.example.org"), (2, "nothing"), (3, None), (4, ""), (5, "10.1.2.3")]
    df = spark.createDataFrame(texts, "id int, body string")
    plain = {r.id: r.body for r in df.select("id", pii.redact(F.col("body"), "HASH", salt=b"s").alias("body")).collect()}
    assert {r.id: r.body for r in pii.redact_hashed(df, "id", "body", b"s").collect()} == plain


def test_partial_masks():
    from tillwise.functions.pii import partial_mask

    assert [partial_mask(v, k) for v, k in (("ann@x.org", "email"), ("a@x", "email"), ("+1 212 555 0123", "phone"), ("12", "phone"), ("4111 1111 1111 1111", "credit_card"), ("078-05-1120", "ssn"), ("078051120", "ssn"), ("10.0.0.1", "ip_address"), ("abc", "name"))] == [
        "an***@x.org", "a***@x", "***-***-0123", "**", "****-****-****-1111", "***-**-1120", "*****1120", "10****.1", "***",
    ]


def test_data_map_of_nothing_still_states_the_fields(spark):
    from tillwise.functions import pii

    none = spark.createDataFrame([], "path string, pii_level string, categories string, types string")
    assert sorted((r.section, r.n) for r in pii.data_map(none, F.lit(12)).collect()) == [("pii_fields", 0), ("total_fields", 12)]


def test_table_function_runs_on_arrow_batches(spark):
    from tillwise.functions import registries

    rows = spark.createDataFrame([(1, "a@b.org or c@d.org"), (2, None), (3, "")], "row long, text string")
    out = registries.PiiSpans(rows.asTable())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and "BatchEvalPython" not in plan
    assert sorted((r.row, r.kind, r.value) for r in out.collect()) == [(1, "email", "a@b.org"), (1, "email", "c@d.org")]


def test_hashed_redaction_of_rows_with_null_and_repeated_ids(spark):
    rows = [(None, "write to a@b.org"), (None, "c@d.org, a@b.org!"), (7, "a@b.org"), (7, "none"), (8, None), (9, "é " * 3000 + "a@b.org " * 500)]
    df = spark.createDataFrame(rows, "id long, body string").repartition(3)
    got = sorted((str(r.id), str(r.body)) for r in pii.redact_hashed(df, "id", "body", b"s", rounds=2).collect())

    def plain(text):
        if text is None:
            return None
        for value in ("a@b.org", "c@d.org"):
            text = text.replace(value, f"<HASH_{pii.slow_hash(value, b's', 2)[:8]}>")
        return text

    assert got == sorted((str(i), str(plain(b))) for i, b in rows)


@pytest.mark.parametrize("value,kind,shown", [
    ("abc@x.org", "email", "ab***@x.org"), ("a@x.org", "email", "a***@x.org"), ("+1 202 555 0143", "phone", "***-***-0143"), ("12345", "phone", "12*45"),
    ("4111-1111-1111-1111", "credit_card", "****-****-****-1111"), ("123-45-6789", "ssn", "***-**-6789"), ("123456789", "ssn", "*****6789"), ("AB123456C", "national_id", "AB*****6C"), ("abcd", "name", "****"),
])
def test_partly_hidden_values(value, kind, shown):
    assert pii.partial_mask(value, kind) == shown


@pytest.mark.parametrize("pattern", ["[{}]", "{0}-{0:>6}", "{:*^9}", "{:^8}|", "{0:<7.3}{{x}}", "{:05}", "{:.2s}", "{0:é>5}", "plain", "", "}}{{"])
def test_text_formats_equal_the_language_s_own(spark, pattern):
    values = ["", "a", "héllo", "much longer than any width"]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    got = {r.v: r.f for r in df.select("v", tr.format_text(F.col("v"), pattern).alias("f")).collect()}
    fits = "{" in pattern.replace("{{", "") or pattern in ("plain", "", "}}{{")
    assert fits and {v: got[v] for v in values} == {v: pattern.format(v) for v in values}


@pytest.mark.parametrize("pattern", ["{} {}", "{1}", "{:d}", "{!r}", "{name}", "{:>5.2f}"])
def test_formats_that_a_text_does_not_fit(spark, pattern):
    with pytest.raises(ValueError):
        tr.format_text(F.lit("x"), pattern)


AWKWARD = ["123", "45", "6789", "-", " ", ".", "(", "+1", "+44 7", "07", "é", "e\u0301", "\u0301", "\u0663", "\u017f", "@", "|", "a", "b.c", "com", "%", "AB", "C", "123456C", "GB123456A", "\n", "1234567", "4111 1111 1111 1111", "202-555-0143", "10.0.0.1", "bob@x.org", "..", "_", "x@y.test"]


def awkward_texts(n):
    import random

    r = random.Random(3)
    return ["".join(r.choice(AWKWARD) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_spans_of_stretches_are_those_of_the_whole_text():
    for field in ("text", "name"):
        whole = [(*s[:4], "text") for s in pii._specs(field)]
        for text in awkward_texts(4000):
            assert pii.spans(text, field) == pii.spans(text, field, whole)


def test_patterns_are_not_tried_outside_of_stretches():
    class Pattern:
        tried = 0

        def finditer(self, text, begin=0, end=None):
            self.tried += (len(text) if end is None else end) - begin
            return iter(())

    spy = Pattern()
    pii.spans("plain words and no numbers " * 1000 + "202-555-0143", specs=[("phone", "MEDIUM", spy, pii._phone_ok, "number")])
    assert 0 < spy.tried < 20


def test_kinds_found_in_the_short_text_are_those_of_the_text(spark):
    df = spark.createDataFrame([(t,) for t in [*awkward_texts(5000), None]], "v string").withColumn("s", pii.numbers(F.col("v")))
    for kind in pii.KINDS[:-1]:
        plain, short = pii.found(F.col("v"), kind), pii.found(F.col("v"), kind, short=F.col("s"))
        assert df.where(~plain.eqNullSafe(short)).count() == 0


def test_notes_are_spread_and_the_data_map_reads_them_once(spark, sf):
    from tillwise.plans.registry import spark_queries

    plan = spark_queries()["agg_pii_data_map"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "REPARTITION_BY_NUM" in plan


def test_shifts_are_dealt_before_they_are_counted(spark, sf):
    from tillwise.plans.standins import Tables

    lines = Tables(spark, sf).shifts._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(lines) if "REPARTITION_BY_NUM" in line)
    branch = [line for line in lines[dealt:] if "lineitem" in line or "HashAggregate" in line]
    assert branch and "HashAggregate" not in branch[0]
