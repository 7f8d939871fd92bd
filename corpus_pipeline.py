"""A corpus pipeline of five stages over ``documents``: quality, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lateweave.llm import stages

STAGES = [
    ("quality", stages.quality_stage),
    ("near_duplicates", stages.near_duplicate_stage),
    ("repeated_passages", stages.repeat_stage),
    ("mixing", stages.mixing_stage),
    ("packing", stages.packing_stage),
]

#: Model scores, token ids and bit-wise fingerprints aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed mix of ``documents``; each stage but the last is kept in the shared folder."""
    return stages.apply(spark, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
