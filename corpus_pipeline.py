"""From documents to packed sequences: five stages, each an operator of lectura.llm over all that the stage before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectura.llm.decontaminate import contamination
from lectura.llm.jaccard import near_duplicates
from lectura.llm.language_id import identify
from lectura.llm.packing import pack
from lectura.llm.repeats import without_repeats
from lectura.llm.tables import shared_dir, small_batches, table, written

#: Rows up to which the ids of near duplicates are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters and those whose language the model doesn't recognise go."""
    small_batches(spark)
    return identify(docs, carry=True).filter("not rejected").select("row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component (five words, a similarity of 0.8) the document of the least doc_id stays; of its repeated rows one.

    Rows are told apart by doc_id and text, so that a doc_id of several texts loses only those that are near duplicates. Rows
    without words all stay.
    """
    small_batches(spark)
    found = near_duplicates(docs, shingle=5, percent=80)
    hashed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    keys = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "first", (F.col("n_shingles") > 0).alias("worded"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text_hash") == F.col("_t"))
    gone = keys.filter("not first").select("_d", "_t").distinct()
    again = keys.filter("first and worded").groupBy("_d", "_t").agg(F.count("*").alias("n")).filter("n > 1").select("_d", "_t")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    gone, again = small(written(gone)), written(again)
    stay = hashed.join(gone, same, "left_anti")
    if not again.limit(1).count():
        return stay.select(*docs.columns)
    again = small(again)
    repeated = stay.join(again, same, "left_semi").dropDuplicates(["doc_id", "_text_hash"])
    return stay.join(again, same, "left_anti").unionByName(repeated).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand anywhere else are cut out of every text, at whole characters."""
    small_batches(spark)
    done = without_repeats(docs, whole_characters=True)
    text = F.col("kept").cast("string")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return done.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    small_batches(spark)
    return contamination(docs, table(spark, sf_dir, "benchmark"), carry=True).filter("not contaminated").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its ids and where it stands in sequences of 2048 tokens."""
    small_batches(spark)
    return pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

#: No stage but the fourth can be said in SQL; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
