"""Corpus preparation in stages, each written and read again before the next.

Models are fitted on the labelled documents of ``sf_dir``, whatever an earlier
stage has left of them; every stage works on all rows that it is given, of the
columns in COLUMNS; further columns are dropped. Null texts count as empty ones
and are rejected by the quality stages, as texts of few words are. Null and
repeated ids are rows like others. Texts of any length are read whole, and an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import gam, line_rules, minhash, packing, queries, secret_scan
from tillwise.session import configure, scratch_path

MOST_NAMES = 100_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return gam.passing(docs.select(*COLUMNS), queries.quality_model(spark, sf_dir))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules reject go."""
    return line_rules.passing(docs.select(*COLUMNS), queries.line_chain(spark, sf_dir))


def with_row_key(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """COLUMNS and ``row_key``, a number per row that is the same whenever the
    table is read, however it is split: the rank of its file by name and its
    place there. A table that is not read from files is written first."""
    try:
        placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        path = scratch_path(spark, "rows")
        docs.select(*COLUMNS).write.parquet(path)
        return with_row_key(spark, spark.read.parquet(path))
    # One name per file, which Spark's driver lists anyway; a table of known size.
    names = sorted(r[0] for r in placed.select("file").distinct().collect())
    files = spark.createDataFrame(list(enumerate(names)), "rank bigint, file string")
    if len(names) <= MOST_NAMES:  # some 100 bytes each; of more files the join is left to Spark
        files = F.broadcast(files)
    key = F.shiftleft("rank", 40) + F.col("place")
    return placed.join(files, "file").select(*COLUMNS, key.alias("row_key"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one of smallest id.

    Rows are told apart by their place in the written table: ids may be null or
    repeated. Null ids come last, so the one of a group stays if it has no other."""
    keyed = with_row_key(spark, docs)
    found = minhash.near_duplicates(keyed, "row_key").select("row_key", "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    kept = found.join(keyed.select("row_key", "doc_id"), "row_key").groupBy("component_id").agg(first["row_key"].alias("row_key")).select("row_key")
    return keyed.join(kept, "row_key", "left_semi").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    clean = secret_scan.redacted(docs.select(*COLUMNS), queries.secret_chain(spark, sf_dir))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of training sequences."""
    packed = packing.pack_documents(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
