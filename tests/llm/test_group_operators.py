"""Operators that bring rows together: near-duplicates, components, chat logs, the pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tillwise.llm import chat, minhash, polytope
from tillwise.llm import queries as llm
from tillwise.llm import text as tx
from tillwise.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    return {n: find(n) for n in nodes}


# components


def test_components_equal_union_find(spark):
    r = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    expected = roots({n for x in links for n in x}, links)
    linked = {n for u, v in links if u != v for n in (u, v)}
    assert got == {n: expected[n] for n in linked}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# MinHash


def sets_of(texts, width=5):
    out = {}
    for key, text in texts.items():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[key] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    return out


def brute_groups(texts):
    sets = sets_of(texts)
    keys = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(keys)
        for b in keys[:i]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    return roots(keys, links), {k: len(v) for k, v in sets.items()}


@pytest.fixture(scope="module")
def family():
    """Exact copies, chains of near copies, short, empty, null and long texts."""
    r = np.random.default_rng(9)
    words = [f"w{k}" for k in range(300)]
    texts, key = {}, 0
    for _ in range(12):
        base = list(r.choice(words, int(r.integers(20, 120))))
        for copy in range(int(r.integers(1, 9))):
            if copy:
                base = list(base)
                base[int(r.integers(0, len(base)))] = f"x{r.integers(0, 5)}"
            texts[key] = " ".join(base)
            key += 1
    for text in (None, "", " \n", "one two", "ONE  two", "one two three", "É a b c d", "é a b c d", "  a", " ".join(words * 40), " ".join(words * 40) + " end"):
        texts[key] = text
        key += 1
    return texts


@pytest.mark.parametrize("block", [2, 512])
def test_near_duplicates_equal_brute_force(spark, family, block):
    """With blocks of two rows, every bucket is dealt over several tasks."""
    rows = spark.createDataFrame([(k, t, "a", 1) for k, t in family.items()], "doc_id bigint, text string, rep string, band int")
    component, sizes = brute_groups(family)
    got = {r.doc_id: r for r in minhash.near_duplicates(rows, params=minhash.Params(block=block)).collect()}
    assert {k: r.component_id for k, r in got.items()} == component
    assert {k: r.n_shingles for k, r in got.items()} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert minhash.near_duplicates(spark.createDataFrame([(1, None), (2, "")], schema)).where("kept").count() == 2
    rows = minhash.near_duplicates(spark.createDataFrame([(3, "a b c"), (3, "a b c"), (None, "a b c"), (7, "A b  c")], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in rows) == [(0, 3, False), (3, 3, True), (3, 3, True), (7, 3, False)]


def test_estimate_is_corrected_for_chance():
    r = np.random.default_rng(3)
    p = minhash.Params()
    for share in (0.0, 0.5, 0.75, 1.0):
        pairs = []
        for _ in range(60):
            common, rest = r.integers(1, 2**62, int(300 * share)), r.integers(1, 2**62, (2, 300 - int(300 * share)))
            sets = [np.unique(np.concatenate([common, rest[k]])).astype(np.uint64) for k in (0, 1)]
            first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            low = tx.mix(minhash._minima(np.concatenate(sets), first, p.hashes)) & np.uint64((1 << p.bits) - 1)
            packed = minhash._pack(low, p.bits)
            pairs.append(minhash.estimate(packed[:1], packed[1:], p)[0, 0])
        assert abs(np.mean(pairs) - share / (2 - share)) < 0.03


def test_exact_links_of_sets():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3], [9], [9], [])]
    every = np.arange(6)
    got = minhash.linked(sets, every, every, 75)
    as_sets = [set(s.tolist()) for s in sets]
    for a in range(6):
        for b in set(range(6)) - {a}:
            union = len(as_sets[a] | as_sets[b])
            assert got[a, b] == (union > 0 and 100 * len(as_sets[a] & as_sets[b]) >= 75 * union)


# embeddings


def brute_links(vectors):
    keys = sorted(vectors)
    good = [k for k in keys if vectors[k] and all(x is not None and np.isfinite(x) for x in vectors[k]) and any(vectors[k])]
    links = []
    for i, a in enumerate(good):
        for b in good[:i]:
            x, y = np.array(vectors[a]), np.array(vectors[b])
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links.append((a, b))
    count = dict.fromkeys(keys, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return roots(keys, links), count


@pytest.mark.parametrize("block", [4, 512])
def test_embedding_links_equal_brute_force(spark, block):
    r = np.random.default_rng(6)
    vectors, key = {}, 0
    for _ in range(25):
        base = r.normal(size=64)
        for _ in range(int(r.integers(1, 12))):
            vectors[key] = [float(x) for x in (base + r.normal(size=64) * r.choice([0.02, 0.15, 0.2])).astype(np.float32)]
            key += 1
    for v in ([1.0] * 64, [1.0] * 64, [2.0] * 64, [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] + [1.0] * 63, None, [], [1.0, 2.0], [1.0, 2.1], [3.0]):
        vectors[key] = v
        key += 1
    rows = spark.createDataFrame([(k, v, 0, "x") for k, v in vectors.items()], "vec_id bigint, embedding array<float>, n int, rep string")
    component, count = brute_links(vectors)
    got = {r.vec_id: r for r in polytope.near_duplicates(rows, params=polytope.Params(block=block)).collect()}
    assert {k: r.n_links for k, r in got.items()} == count
    assert {k: r.component_id for k, r in got.items()} == component
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_links_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert polytope.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = polytope.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in rows) == [(0, 0, False), (1, 0, True), (1, 0, True)]


def test_hadamard_turns_without_stretching():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose((polytope.hadamard(x) ** 2).sum(1), (x**2).sum(1))
    assert np.allclose(polytope.hadamard(polytope.hadamard(x)), x)


# chat


EVENTS = "conversation bigint, message bigint, sequence bigint, role string, kind string, text string, place int"


def folded(spark, events):
    rows = chat.fold(spark.createDataFrame([(*e, 0) for e in events], EVENTS)).collect()
    return sorted(((r.conversation, r.message, r.role, r.text) for r in rows), key=lambda r: (r[0] is None, r))


def test_fold_of_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 1, "user", "delta", "Hel"),
        (1, 0, 2, "user", "delta", "lo"),
        (1, 1, 3, "assistant", "delta", "bad answer"),
        (1, 1, 4, "assistant", "regenerate", None),
        (1, 1, 5, "assistant", "delta", "good "),
        (1, 1, 6, "assistant", "delta", "answer"),
        (2, 0, 1, "user", "delta", "first"),
        (2, 1, 2, "assistant", "delta", "taken back by the edit"),
        (2, 0, 3, "user", "edit", "second"),
        (2, 1, 4, "assistant", "delta", "new"),
        (2, 2, 5, None, "delta", None),
        (None, 0, 1, "user", "delta", "now"),
        (None, 1, 2, "user", "delta", "taken back as well"),
        (None, 0, 3, "user", None, "here"),
        (None, 0, 4, "user", "edit", "nowhere"),
        (4, None, 1, "user", "delta", "no message"),
        (5, 0, None, "user", "delta", "no number "),
        (5, 0, 1, "user", "odd", "and an odd kind"),
        (6, 0, None, "user", "delta", "taken back"),
        (6, 0, 1, "user", "edit", "edited"),
        (3, 0, 1, "user", "delta", "a"),
        (3, 0, 1, "user", "delta", "a"),
    ]
    assert folded(spark, events) == [
        (1, 0, "user", "Hello"),
        (1, 1, "assistant", "good answer"),
        (2, 0, "user", "second"),
        (2, 1, "assistant", "new"),
        (2, 2, "", ""),
        (3, 0, "user", "aa"),
        (5, 0, "user", "no number and an odd kind"),
        (6, 0, "user", "edited"),
        (None, 0, "user", "nowhere"),
    ]
    assert folded(spark, []) == []


def test_events_of_the_query_regenerate_and_take_back(spark):
    turns = spark.createDataFrame([(1, 0, "user", "héllo"), (1, 0, "user", "x"), (1, 1, "assistant", None), (None, None, "user", "ok"), (None, 3, None, "y")], "conv_id bigint, turn int, role string, text string")
    events = llm.chat_events(turns)
    assert {r.kind for r in events.select("kind").collect()} == {"delta", "edit", "regenerate"}
    rows = chat.fold(events).collect()
    assert sorted((str(r.conversation), str(r.message.turn), r.role, r.text) for r in rows) == sorted([("1", "0", "user", "héllo"), ("1", "0", "user", "x"), ("1", "1", "assistant", ""), ("None", "None", "user", "ok"), ("None", "3", "", "y")])


AWKWARD = ["\\### Assistant: </turn> ok", "\\b\\l\\h\\\\<#", "</turn>\n### user: x", "", "ends with \\", "tab\tline\n\n", "😀 é: \\c", "x" * 200_000]


@pytest.mark.parametrize("block", [2, 256])
def test_format_reads_back(spark, block):
    rows = [(1, k, "assistant" if k % 2 else "user: \\<", t) for k, t in enumerate(AWKWARD)] + [(2, 0, None, None)]
    messages = spark.createDataFrame(rows, "conversation bigint, message bigint, role string, text string")
    done = chat.render(messages, block=block)
    done = done.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss_text", chat.under_mask(F.col("formatted"), F.col("loss")))
    got = {r.conversation: r for r in done.collect()}
    assert [tuple(m) for m in got[1].back] == [(r[2], r[3]) for r in rows[:-1]]
    assert got[1].loss_text == [t for k, t in enumerate(AWKWARD) if k % 2]
    assert [tuple(m) for m in got[2].back] == [("", "")]
    assert chat.render(messages.where("false")).count() == 0


def test_chat_plan_has_no_python(spark, sf):
    plan = llm.QUERIES["op1_chat_format"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_one_id_with_many_texts_stays_linear(spark):
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(60):  # near copies of each other, all of one id
        words = list(base)
        words[int(rng.integers(0, 80))] = f"x{k}"
        rows.append((7, " ".join(words)))
    rows += [(7, rows[0][1])] * 30 + [(9, rows[5][1]), (3, " ".join(f"other{k}" for k in range(50)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(7, 7), (9, 7), (3, 3)}


# pipeline


def test_pipeline_equals_its_operators_and_a_brute_force_dedup(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    good = {r[0] for r in llm.QUERIES["op5_quality_classifier"](spark, sf).where("predicted = 1").select("doc_id").collect()}
    assert {r.doc_id for r in seen["quality_classifier"][1].collect()} == good
    ruled = {r[0] for r in llm.QUERIES["op8_quality_rules"](spark, sf).where("kept").select("doc_id").collect()}
    assert {r.doc_id for r in seen["quality_rules"][1].collect()} == good & ruled
    component, _ = brute_groups({r.doc_id: r.text for r in seen["near_dedup"][0].collect()})
    assert {r.doc_id for r in seen["near_dedup"][1].collect()} == {k for k, v in component.items() if k == v}
    before, after = ({r.doc_id: r for r in x.collect()} for x in seen["secret_scan"])
    assert before.keys() == after.keys()
    for key, r in after.items():
        assert r.n_chars == len(r.text)
        assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.text)
        if "<secret>" not in r.text:
            assert r.text == before[key].text
    assert {r.doc_id for r in seen["packing"][1].collect()} == set(after)


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(llm.SQL) <= set(llm.QUERIES)
