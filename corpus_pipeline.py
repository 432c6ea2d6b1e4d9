"""A training-corpus pipeline over `documents`: each stage works on all that the one before it kept.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. Stages are written to the shared folder as Parquet and read again.

A stage runs in executors that the stages before it have filled, so stages hand texts to Python in small batches: they set the
session's spark.sql.execution.arrow.maxBytesPerBatch, and leave it set, as what they return runs later.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.llm import bpe, decontam, neardup, quality, substring
from geomill.llm.queries import VOCABULARY, table
from geomill.llm.shared import small_batches, written


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sampler selects; a repeated id stays if one of its rows is drawn, rows without an id stay."""
    drawn = quality.importance_sample(docs, table(spark, sf_dir, "labels")).groupBy("doc_id").agg(F.bool_or("selected").alias("kept"))
    gone = drawn.where("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies; rows without an id, and repeated rows of a first document, stay."""
    return neardup.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages. A text that loses nothing stays as it is written; of one that loses words, the kept
    words are joined by single spaces, so its line breaks go. Null texts stay null."""
    out = substring.dedup_substrings(docs.withColumn("_kept", F.col("text")))
    text = F.when(F.col("n_removed") == 0, F.col("_kept")).otherwise(F.col("kept_text"))
    out = out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item; rows without an id stay."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; null: none."""
    return bpe.encode_column(docs, VOCABULARY).select("doc_id", "lang", "source", "n_tokens", "input_ids")


STAGES = [
    ("quality", in_small_batches(select_quality)),
    ("near_duplicates", in_small_batches(drop_near_copies)),
    ("substrings", in_small_batches(remove_repeats)),
    ("decontamination", in_small_batches(drop_benchmark_copies)),
    ("tokens", in_small_batches(tokenize)),
]

ORACLE_SQL = None  # sketches, samplers and subword merges have no SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
