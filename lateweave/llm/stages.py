"""The operators as stages of a pipeline: (spark, docs, sf_dir) to a DataFrame with the columns of ``docs``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, packing, quality, resemblance, suffix_dedup, tokens
from .common import fresh_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model of the rated ones rejects go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.select(docs, quality.train(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; its links are 0.8 of the five-word shingles or more."""
    return resemblance.keep_one(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that occurred before go; documents of which nothing is left go."""
    return suffix_dedup.cleaned(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the one at a source's cut up to its last word taken."""
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.packed(docs, tokens.default_tokenizer())


def apply(spark: SparkSession, stages: list[tuple[str, Callable]], docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages in turn; between two of them the rows are written to the shared folder and read again."""
    for name, stage in stages[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return stages[-1][1](spark, docs, sf_dir)
