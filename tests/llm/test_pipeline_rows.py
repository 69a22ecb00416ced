"""The near-duplicate stage on rows with null and repeated ids."""

import corpus_pipeline


def test_near_dedup_decides_by_row(spark, tmp_path):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    given = [(None, "a"), (5, "b"), (5, "b"), (None, "b"), (1, "c"), (2, "c"), (2, "d"), (None, "e"), (None, "e")]
    rows = [(i, text[k], "en", "s", 1) for i, k in given]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(path)
    done = corpus_pipeline.near_dedup(spark, spark.read.parquet(path), "").collect()
    kept = sorted((r.text[0], r.doc_id) for r in done)
    assert kept == [("a", None), ("b", 5), ("c", 1), ("d", 2), ("e", None)]


def test_row_keys_do_not_depend_on_splits(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(i, f"text {i}", "en", "s", 1) for i in range(5000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5).write.option("parquet.block.size", 4096).parquet(path)
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in sizes}
    keys = []
    try:
        for size in ("128m", "3000", "20000"):
            for k in sizes:
                spark.conf.set(k, size)
            docs = spark.read.parquet(path)
            keys.append(({r.doc_id: r.row_key for r in corpus_pipeline.with_row_key(spark, docs).collect()}, docs.rdd.getNumPartitions()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert keys[0][0] == keys[1][0] == keys[2][0] and len(set(keys[0][0].values())) == 5000
    assert len({n for _, n in keys}) > 1


def test_rows_that_are_not_read_from_files_are_written_first(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5, 9), (None, "a b c", "en", "s", 5, 9), (1, "a b c", "en", "s", 5, 9)], "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key int")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
