"""Delimited text with quoted line breaks, read in splits."""

import csv
import io

import numpy as np
import pytest

from tillwise.sources import delimited, files

SPLIT = "spark.sql.files.maxPartitionBytes"
OPEN = "spark.sql.files.openCostInBytes"


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in (SPLIT, OPEN)}

    def cut(n):
        spark.conf.set(SPLIT, str(n))
        spark.conf.set(OPEN, "1")

    yield cut
    for k, v in old.items():
        spark.conf.set(k, v)


def expected(text, width, skip=0):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return [tuple((r + [""] * width)[:width]) for r in rows[skip:]]


def awkward(seed, n):
    """Values with quotes, breaks, separators, blanks and loose quotes."""
    rng = np.random.default_rng(seed)
    parts = ["a", "bé", ",", "\n", '""', "\r\n", "\r", " ", "0123456789" * 3]
    out = []
    for _ in range(n):
        row = []
        for _ in range(rng.integers(1, 5)):
            kind = rng.integers(0, 4)
            body = "".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 9)))
            row.append([f'"{body}"', f'"{body}"tail', "x", 'xy"z'][kind])
        out.append(",".join(row))
        if rng.integers(0, 6) == 0:
            out.append("")  # a blank line
    return ("\n" if seed % 2 else "\r\n").join(out) + "\n"


@pytest.mark.parametrize("seed,size", [(1, 17), (2, 64), (3, 301), (4, 5000)])
def test_any_split_gives_the_records_of_the_whole(spark, tmp_path, small_splits, seed, size):
    text = awkward(seed, 150)
    (tmp_path / "a.csv").write_bytes(text.encode())
    small_splits(size)
    lines = delimited.text_lines(spark, str(tmp_path))
    got = delimited.records(lines, ["a", "b", "c"], delimited.Dialect())
    if size < 100:
        assert lines.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, got.collect())) == sorted(expected(text, 3))


def test_skip_and_first_records_over_files_and_splits(spark, tmp_path, small_splits):
    texts = {f"{k}.csv": awkward(10 + k, 40) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    small_splits(40)
    whole = [r for name in sorted(texts) for r in expected(texts[name], 2, skip=3)]
    for n in (None, 1, 30, 60, 10_000):
        got = files.scan_csv(spark, str(tmp_path), columns=["a", "b"], skip_rows=2, max_rows=n)
        assert sorted(map(tuple, got.collect())) == sorted(whole[:n])


def test_a_record_over_many_splits_and_an_open_end(spark, tmp_path, small_splits):
    long = "line\n" * 400
    (tmp_path / "a.csv").write_text(f'h,k\n1,"{long}"\n2,"open\nto the end')
    small_splits(50)
    got = sorted(map(tuple, files.scan_csv(spark, str(tmp_path)).collect()))
    assert got[0] == ("1", long) and got[1][0] == "2" and got[1][1].startswith("open\nto the end")


def test_encodings_and_mark(spark, tmp_path, small_splits):
    small_splits(30)
    (tmp_path / "a.csv").write_bytes(('n;v\n"é\nè";1\n' * 20).encode("ISO-8859-1"))
    got = files.scan_csv(spark, str(tmp_path), sep=";", encoding="ISO-8859-1", columns=["n", "v"], header=False)
    assert got.where("n = 'é\nè'").count() == 20
    other = tmp_path / "u"
    other.mkdir()
    (other / "a.csv").write_bytes(b"\xef\xbb\xbf" + "k,v\n1,2\n".encode())
    assert files.scan_csv(spark, str(other), columns=["k", "v"]).collect() == [("1", "2")]
    wide = tmp_path / "w"
    wide.mkdir()
    (wide / "a.csv").write_bytes('k,v\n1,"a\nb"\n'.encode("UTF-16LE"))
    assert files.scan_csv(spark, str(wide), encoding="UTF-16LE").collect() == [("1", "a\nb")]


def test_empty_files_and_changed_splits(spark, tmp_path, small_splits):
    (tmp_path / "empty.csv").write_text("")
    assert files.scan_csv(spark, str(tmp_path), columns=["a"]).count() == 0
    (tmp_path / "b.csv").write_text("a\n" + "1\n" * 500)
    small_splits(100)
    df = files.scan_csv(spark, str(tmp_path), columns=["a"])
    small_splits(70)
    with pytest.raises(Exception, match="cut differently"):
        df.count()


def test_only_some_files_hold_a_record_over_a_border(spark, tmp_path):
    # Splits follow the size of all files here, so a read of fewer files would be cut otherwise.
    settings = {"spark.sql.files.minPartitionNum": "5", SPLIT: "1g", OPEN: "1"}
    old = {k: spark.conf.get(k, None) for k in settings}
    (tmp_path / "a.csv").write_text("k,v\n" + "1,x\n" * 300)
    (tmp_path / "b.csv").write_text('k,v\n2,"' + "line\n" * 200 + '"\n' + "3,y\n" * 100)
    (tmp_path / "c.csv").write_text("k,v\n4,z\n")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = files.scan_csv(spark, str(tmp_path))
        got = sorted(map(tuple, df.collect()))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == sorted([("1", "x")] * 300 + [("2", "line\n" * 200)] + [("3", "y")] * 100 + [("4", "z")])


@pytest.mark.parametrize("skip,most", [(0, None), (2, None), (5, 45)])
def test_records_keep_their_place_in_the_file(spark, tmp_path, small_splits, skip, most):
    texts = {f"{k}.csv": awkward(20 + k, 40 + 10 * k) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    small_splits(40)  # many records reach over a border
    whole = [(*r, i) for name in sorted(texts) for i, r in enumerate(expected(texts[name], 2, skip=skip + 1), 1)]
    got = files.scan_csv(spark, str(tmp_path), columns=["a", "b"], skip_rows=skip, max_rows=most, numbered="n")
    assert sorted(map(tuple, got.collect())) == sorted(whole[:most])


def test_places_by_the_readers_of_spark(spark, tmp_path, small_splits):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text("k,v.w\n" + "".join(f"{k},{i}\n" for i in range(1, 300)))
    small_splits(200)
    got = files.scan_csv(spark, str(tmp_path), multi_line=False, numbered="n").collect()
    assert len(got) == 598 and all(r["v.w"] == str(r.n) for r in got)
    got = files.scan_csv(spark, str(tmp_path), multi_line=False, columns=["k", "v"], skip_rows=3, numbered="n").collect()
    assert len(got) == 592 and all(int(r.v) == r.n + 3 for r in got)
    wide = tmp_path / "w"
    wide.mkdir()
    (wide / "a.csv").write_bytes('k,v\n1,"a\nb"\n2,c\n'.encode("UTF-16LE"))
    assert sorted(files.scan_csv(spark, str(wide), encoding="UTF-16LE", numbered="n").collect()) == [("1", "a\nb", 1), ("2", "c", 2)]
