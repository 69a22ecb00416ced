"""Long texts, hot ids and values of every shape."""

import datetime
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm import gam, line_rules, packing, pseudonyms, secret_scan


def test_contacts_of_five_megabytes_take_seconds():
    r = random.Random(1)
    text = " ".join(f"mail user{r.randrange(10**6)}@site{r.randrange(999)}.org on 2023-0{r.randrange(1, 9)}-1{r.randrange(9)} from 10.{r.randrange(200)}.3.4" for _ in range(80_000))
    assert len(text) > 4_500_000
    start = time.process_time()
    found = pseudonyms.find(text, pseudonyms.Permuter(b"k"))
    assert len(found) > 200_000 and time.process_time() - start < 60
    assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))


def plain_dates_and_addresses(text):
    """A detector of its own: every stretch that could be a value is tried."""
    out = []
    for m in re.finditer(r"(?<![\w./-])(\d{4})-(\d\d)-(\d\d)(?![\w/-])", text):
        try:
            datetime.date(*map(int, m.groups()))
            out.append((m.start(), m.end(), "date"))
        except ValueError:
            pass
    return out


def test_dates_are_found_like_a_plain_detector():
    r = random.Random(3)
    words = []
    for _ in range(400):
        y, m, d = r.randrange(1950, 2030), r.randrange(0, 15), r.randrange(0, 34)
        words.append(r.choice(["and", "at", f"{y:04d}-{m:02d}-{d:02d}", f"{y:04d}-{m:02d}-{d:02d},"]))
    text = " ".join(words)
    found = [(f.start, f.end, f.kind) for f in pseudonyms.find(text, pseudonyms.Permuter(b"k")) if f.kind == "date"]
    assert found == plain_dates_and_addresses(text) and len(found) > 50


def test_many_secrets_in_one_text():
    text = "\n".join(f"password = abc{k}defXYZ9 and token: zz{k}yyyyQ1" for k in range(20_000))
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    chain = secret_scan.crf.fit(np.zeros((0, len(secret_scan.SLOTS)), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), secret_scan.N_IDS, 3, 1)
    start = time.process_time()
    spans = secret_scan.scan_slice(data, offsets, chain, secret_scan.Params())[0]
    assert sum(k == "assign" for _, _, k in spans) == 40_000 and time.process_time() - start < 60


def test_windows_hold_the_whole_text():
    r = random.Random(5)
    for _ in range(50):
        text = "".join(r.choice(["word ", "line\n", "é", "x" * r.randrange(1, 40), " "]) for _ in range(r.randrange(0, 300)))
        cut = secret_scan.windows(text, 60)
        assert "".join(cut) == text and all(0 < len(w) <= 60 for w in cut)


def test_samples_are_bounded_whatever_the_rows_of_an_id(spark):
    rows = [(7, f"password = abc{k}defg\n" + "some plain words here " * 400) for k in range(300)] + [(k, "other words " * 30) for k in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    p = secret_scan.Params(fit_windows=25, plain_windows=10)
    found = secret_scan.sample(docs, "doc_id", "text", p)
    assert sum("password" in w for w in found) == 25 and 25 < len(found) <= 35
    # what is likely may stand anywhere in a text
    late = spark.createDataFrame([(1, "plain words " * 3000 + "\nsecret: abcdef123\n" + "more " * 3000)], "doc_id bigint, text string")
    assert any("secret: abcdef123" in w for w in secret_scan.sample(late, "doc_id", "text", p))
    labels = spark.createDataFrame([(7, 1), (100, 0), (101, 1)], "doc_id bigint, quality int")
    model = gam.train(docs, labels)
    assert np.isfinite(model.intercept)
    line_rules.train(docs, labels, params=line_rules.Params(fit_stretches=5, fit_lines=1, epochs=2))


@pytest.mark.parametrize("kind", ["smallint", "int", "string", "decimal(9,1)", "date", "double"])
def test_packing_takes_ids_of_any_type(spark, kind):
    ids = F.date_add(F.lit(datetime.date(2024, 1, 1)), F.col("id").cast("int")) if kind == "date" else F.col("id").cast(kind)
    docs = spark.range(20).select(ids.alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"))
    out = packing.pack_documents(docs)
    assert dict(out.dtypes)["doc_id"] == kind and out.select("doc_id").distinct().count() == 20
