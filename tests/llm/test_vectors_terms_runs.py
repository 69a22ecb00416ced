"""Vector codes, toxicity terms and periodic runs."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillwise.llm import codes, interactions, periodic, queries as llm
from tillwise.llm import text as tx

# --- vector codes -------------------------------------------------------------


def plain_codes(vectors, entries=256, rounds=4, parts=4):
    """Every part against every entry, in Python integers."""
    x = np.array([[math.floor(1024 * float(v)) for v in row] for _, row in vectors], object)
    width = x.shape[1] // parts
    cut = lambda p: x[:, p * width : (p + 1) * width]
    books = [[list(r) for r in cut(p)[:entries]] for p in range(parts)]
    for r in range(rounds + 1):
        found = []
        for p in range(parts):
            d = [[sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in books[p]] for row in cut(p)]
            best = [min(range(len(row)), key=lambda e: (row[e], e)) for row in d]
            found.append((best, [row[e] for row, e in zip(d, best, strict=True)]))
            if r < rounds:
                for e in range(len(books[p])):
                    mine = [row for row, b in zip(cut(p), best, strict=True) if b == e]
                    if mine:
                        books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    code = ["".join(f"{found[p][0][k]:02x}" for p in range(parts)) for k in range(len(x))]
    error = [sum(found[p][1][k] for p in range(parts)) for k in range(len(x))]
    return code, error, [v for book in books for c in book for v in c]


@pytest.mark.parametrize("n,dim,entries,scale", [(60, 8, 16, 0.3), (5, 4, 256, 0.3), (90, 12, 8, 900.0), (40, 4, 7, 0.002)])
def test_codes_equal_the_plain_rounds(spark, n, dim, entries, scale):
    rng = np.random.default_rng(n)
    vectors = [(k, (rng.normal(size=dim) * scale).astype(np.float32).tolist()) for k in range(n)]
    vectors[3] = (3, vectors[1][1])  # ties and repeated vectors
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    coded, found = codes.compress(df, params=codes.Params(entries=entries, bounds=5))
    code, error, books = plain_codes(vectors, entries)
    assert {r.vec_id: (r.code, r.error) for r in coded.collect()} == {k: (code[k], error[k]) for k in range(n)}
    assert found.books.reshape(-1).tolist() == books


@pytest.mark.parametrize("seed", range(6))
def test_bounds_decide_like_a_full_search(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-60, 60, (400, 3))
    book = x[: int(rng.integers(2, 40))].copy()
    b = min(int(rng.integers(0, 9)), len(book) - 1)
    code, near, low = codes.search(x, book, b)
    for step in (9, 4, 2, 1, 0):
        old = book
        book = book + rng.integers(-step, step + 1, book.shape)
        moved = np.sqrt(((book - old) ** 2).sum(1)) * (1 + 1e-9)
        code, near, low, need = codes.reassign(x, book, moved, code, near, low)
        assert (code == codes.closest(x, book, 1)[0][:, 0]).all()
        exact = np.sqrt(codes.distances(x, book).astype(float))
        assert (np.take_along_axis(exact, near.astype(np.int64), 1) >= low[:, :-1] - 1e-9).all()
        if step == 0:
            assert (need > 0).mean() < 0.2  # nothing moved: only near ties are looked at
        b = codes.cheapest(np.bincount(need, minlength=b + 2).astype(float), len(book), 1)
        near, low = codes.shortened(near, low, b)


def test_large_components_stay_exact():
    x = np.array([[1 << 24, 0], [-(1 << 24), 5], [(1 << 24) - 1, 0]] * 2)
    book = np.array([[1 << 24, 1], [(1 << 24) - 1, 0], [0, 0]])
    want = [[sum((int(a) - int(c)) ** 2 for a, c in zip(r, e, strict=True)) for e in book] for r in x]
    assert codes.distances(x, np.repeat(book, 64, axis=0))[:, ::64].tolist() == want


def test_vectors_that_have_no_code(spark):
    good = [0.5, -0.25, 1.0, 2.0]
    rows = [(5, good, "a"), (None, good, None), (1, None, "a"), (2, [None, 1.0, 1.0, 1.0], "a"), (3, [float("nan")] * 4, None), (4, [float("inf")] * 4, "b"),
            (6, [1.0] * 3, None), (7, [], "a"), (8, [1e9, 0.0, 0.0, 0.0], "b"), (5, [0.0, 0.0, 0.0, 0.0], "c"), (5, good, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("code_", F.lit(1)).withColumn("x", F.lit(2)).withColumn("part", F.lit(3))
    coded, found = codes.compress(df, keep=("label",))
    got = sorted((str(r.vec_id), str(r.label), r.code) for r in coded.collect())
    # id 5 starts one entry, with its smallest vector; of rows without a code, id and label stay
    assert found.books.shape == (4, 1, 1)
    assert got == sorted([("5", "a", "00000000"), ("5", "a", "00000000"), ("5", "c", "00000000"), ("None", "None", "00000000"), ("6", "None", None), ("7", "a", None), ("8", "b", None)], key=lambda r: (r[0], r[1]))
    nothing, none = codes.compress(df.limit(0))
    assert none is None and nothing.count() == 0 and nothing.columns == ["vec_id", "code", "error"]
    with pytest.raises(ValueError, match="named like results"):
        codes.compress(df.withColumnRenamed("label", "code"), keep=("code",))


def test_op11_covers_every_usable_vector(spark, sf):
    rows = llm.QUERIES["op11_vector_codes"](spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    code, error, books = plain_codes([(r.vec_id, r.embedding) for r in table])
    assert {r.vec_id: (r.code, r.error) for r in rows} == {r.vec_id: (code[k], error[k]) for k, r in enumerate(table)}
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in rows} == {digest}
    by_label = {}
    for r, e in zip(table, error, strict=True):
        by_label[r.label] = by_label.get(r.label, 0) + e
    labels = {r.vec_id: r.label for r in table}
    assert all(r.label_error == by_label[labels[r.vec_id]] for r in rows)


# --- toxicity -------------------------------------------------------------------


def plain_margin(model, terms):
    pairs = sum(float(model.factor[a] @ model.factor[b]) for i, a in enumerate(terms) for b in terms[:i])
    return model.bias + sum(model.weight[t] for t in terms) + pairs / math.sqrt(max(1, len(terms)))


def test_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(0)
    model = interactions.Model(-0.5, rng.normal(size=50), rng.normal(size=(50, 4)))
    lists = [rng.choice(50, n, replace=False) for n in (0, 1, 7, 30, 0)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    got = interactions.margin(model, np.concatenate(lists).astype(np.int64), first)[0]
    assert np.allclose(got, [plain_margin(model, x) for x in lists])


def test_terms_are_words_and_their_beginnings():
    p = interactions.Params()
    texts = ["Some WORDS, some-words!", "", None, "wordsmith", "Ünwörd ünwörd", "a1b"]
    data, offsets = tx.utf8(pa.array(texts, pa.string()))
    terms, first = interactions.terms_of(data, offsets, p)
    of = [set(terms[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
    # some, words, word(s): two words and a beginning of four letters
    assert [len(x) for x in of] == [3, 0, 0, 3, 6, 2]
    assert len(of[0] & of[3]) == 1 and all((terms[a:b][1:] > terms[a:b][:-1]).all() for a, b in zip(first[:-1], first[1:], strict=True))


def test_pairs_that_only_matter_together_are_learned():
    rng = np.random.default_rng(4)
    p = interactions.Params(buckets=64, factor_rate=0.2, rate=0.05, rounds=150, least_texts=1)
    lists, y = [], []
    for _ in range(800):
        a, b = rng.random(2) < 0.5
        lists.append(sorted({*([1] if a else []), *([2] if b else []), *rng.integers(10, 60, 3).tolist()}))
        y.append(float(a and b))
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    model = interactions.fit(np.concatenate(lists).astype(np.int64), first, np.array(y), p)
    score = model.score(np.concatenate(lists).astype(np.int64), first)
    assert ((score >= 0.5) == np.array(y, bool)).mean() > 0.97
    assert model.factor[1] @ model.factor[2] > 0.5


def labelled(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    base = [f"word{k}" for k in range(60)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choice(base, 30).tolist()
        bad = rng.random() < 0.3
        if bad:
            words[int(rng.integers(0, 30))] = ["dreadful", "wretched"][int(rng.integers(0, 2))]
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_toxicity(spark):
    docs, labels = labelled(spark)
    model = interactions.train(docs, labels.where("doc_id < 300"))
    rows = interactions.score(docs.where("doc_id >= 300"), model).join(labels, "doc_id").collect()
    assert sum((r.predicted == 1) == (r.toxic == 1) for r in rows) / len(rows) > 0.95
    # the same rows and text give the same model
    again = interactions.train(docs.repartition(7), labels.where("doc_id < 300"))
    assert np.array_equal(model.weight, again.weight) and np.array_equal(model.factor, again.factor)


def test_toxicity_on_odd_rows(spark):
    docs, labels = labelled(spark, 60)
    odd = docs.unionByName(spark.createDataFrame([(None, "dreadful"), (900, None), (901, ""), (5, "repeated"), (5, "repeated")], docs.schema)).withColumn("y_", F.lit(1)).withColumn("score", F.lit(2))
    bad_labels = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 7), (5, 1), (5, 0)], labels.schema))
    model = interactions.train(odd, bad_labels)
    rows = interactions.score(odd, model).collect()
    assert len(rows) == 65 and all(0 <= r.score <= 1 for r in rows)
    empty = [r.score for r in rows if r.doc_id in (900, 901)]
    assert empty == [pytest.approx(1 / (1 + math.exp(-model.bias)))] * 2
    assert interactions.score(odd.limit(0), model).count() == 0
    for nothing in (bad_labels.limit(0), labels.where("toxic = 0")):
        flat = interactions.train(docs, nothing)
        n = nothing.count()
        assert {round(r.score, 9) for r in interactions.score(docs, flat).collect()} == {round(1 / (n + 2), 9)}
    few = interactions.Params(sample_rows=20, sample_terms=500)
    kept = interactions.sample(docs, labels, "doc_id", "text", "toxic", few).collect()
    assert 0 < len(kept) <= 20 and sum(len(r.terms) for r in kept) <= 500


def test_op12_scores_every_document(spark, sf):
    rows = llm.QUERIES["op12_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)


# --- periodic runs ----------------------------------------------------------------


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng, n):
    w = []
    while len(w) < n:
        period = [["a", "b", "cc", "é"][k] for k in rng.integers(0, rng.integers(1, 5), rng.integers(1, 14))]
        w += (period * 60)[: int(rng.integers(1, 70))]
    return w[:n]


@pytest.mark.parametrize("size", [1, 2, 8, 64, 1024])
def test_transforms_undo_each_other_and_correlate(size):
    rng = np.random.default_rng(size)
    x = rng.integers(0, periodic.PRIME, (size, 3))
    assert (periodic.inverse_transform(periodic.transform(x)) * pow(size, -1, periodic.PRIME) % periodic.PRIME == x).all()
    if size > 1:
        codes_ = rng.integers(0, 3, 8 * size)
        at, distance = periodic.recurrences(codes_, size, size)
        want = {(j, d) for j in range(0, 8 * size, size) for d in range(size, 2 * size) if j + d + size <= 8 * size and (codes_[j : j + size] == codes_[j + d : j + d + size]).all()}
        got = {(j, d) for j, d in zip(at.tolist(), distance.tolist(), strict=True) if j + d + size <= 8 * size}
        assert want <= got and len(got - want) <= 1


def test_runs_equal_brute_force():
    rng = np.random.default_rng(11)
    for _ in range(60):
        texts = [repetitive(rng, int(rng.integers(0, 150))) for _ in range(rng.integers(1, 6))]
        words = tx.words_of(*tx.utf8(pa.array([" ".join(t) for t in texts])))
        found = periodic.slice_runs(words, periodic.Params())
        out = periodic._collapsed(words, found).to_pylist()
        for k, w in enumerate(texts):
            runs = [tuple(map(int, r[1:])) for r in found if r[0] == k]
            assert runs == plain_runs(w) and out[k] == collapsed(w, runs)


@pytest.mark.parametrize("n,period", [(150_000, 1), (150_000, 35_000), (140_000, 34_999)])
def test_very_long_texts(n, period):
    w = [str(i % period) for i in range(n)]
    w[-1] = "end"
    words = tx.words_of(*tx.utf8(pa.array([" ".join(w), "a b"])))
    assert periodic.slice_runs(words, periodic.Params()).tolist() == [[0, 0, n - 1, period]]


def test_long_patterns_go_in_steps(monkeypatch):
    monkeypatch.setattr(periodic, "LONGEST", 4)
    rng = np.random.default_rng(2)
    for _ in range(25):
        w = repetitive(rng, int(rng.integers(50, 400)))
        words = tx.words_of(*tx.utf8(pa.array([" ".join(w)])))
        assert [tuple(map(int, r[1:])) for r in periodic.slice_runs(words, periodic.Params())] == plain_runs(w)


def test_runs_of_odd_rows(spark):
    rows = [(1, "x " * 10), (1, "x " * 10), (None, " a b a b\ta b\na b a "), (2, None), (3, ""), (4, "\n\t "), (5, "x x x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("period", F.lit("p"))
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(df, ["doc_id"]).collect())
    assert got == [("1", [(0, 10, 1)], "x"), ("1", [(0, 10, 1)], "x"), ("2", [], ""), ("3", [], ""), ("4", [], ""), ("5", [], "x x x"), ("None", [(0, 9, 2)], "a b")]
    assert periodic.find_runs(df.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="named like results"):
        periodic.find_runs(df.withColumnRenamed("start", "runs"), ["runs"])
    with pytest.raises(ValueError, match="exponent"):
        periodic.find_runs(df, ["doc_id"], params=periodic.Params(exponent=2))


def test_op13_equals_brute_force_on_whole_documents(spark, sf):
    import re

    rows = {r.doc_id: r for r in llm.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    again = 0
    for doc_id, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            again += 1
        runs = plain_runs(w)
        r = rows[doc_id]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert len(rows) == len(docs) and again > 5
