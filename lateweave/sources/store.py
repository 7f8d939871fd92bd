"""Where encodings, lists, packs, truths and reports are kept: Parquet and CSV that any executor can read.

A store is a folder with Parquet data and, beside it, one row of settings as JSON; what was written with other settings
is not read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import exists
from ..plans.config import FdeConfig


def save_blocks(found: DataFrame, cfg: FdeConfig, path: str, by: str = "rep") -> None:
    """Blocks partitioned by repetition, so that a subset of repetitions reads only those."""
    found.write.mode("overwrite").partitionBy(by).parquet(f"{path}/data")
    found.sparkSession.createDataFrame([(json.dumps(cfg.meta(), sort_keys=True),)], "settings string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def stored_config(spark: SparkSession, path: str) -> FdeConfig | None:
    """The settings of a store; None if there is none."""
    if not exists(spark, f"{path}/meta"):
        return None
    row = spark.read.schema("settings string").json(f"{path}/meta").first()
    return FdeConfig.from_meta(json.loads(row["settings"])) if row else None


def load_blocks(spark: SparkSession, path: str, cfg: FdeConfig | None = None) -> DataFrame | None:
    """The stored blocks, or None if there are none or they were made with other settings."""
    stored = stored_config(spark, path)
    if stored is None or (cfg is not None and stored != cfg):
        return None
    return spark.read.parquet(f"{path}/data")


def load_or_build(spark: SparkSession, path: str, cfg: FdeConfig, build) -> DataFrame:
    """The stored blocks if their settings are ``cfg``, else those that ``build()`` gives, stored."""
    found = load_blocks(spark, path, cfg)
    if found is None:
        save_blocks(build(), cfg, path)
        found = load_blocks(spark, path, cfg)
    return found


def save_lists(postings: DataFrame, centers: DataFrame, path: str) -> None:
    """Postings partitioned by list: a probe reads only its lists."""
    postings.write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/postings")
    centers.write.mode("overwrite").parquet(f"{path}/centers")


def load_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/centers")


def save_hashes(hashes: DataFrame, path: str) -> None:
    """Hash tables by table: a probe of one table reads only its folder."""
    hashes.write.mode("overwrite").partitionBy("table_id").parquet(path)


def load_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("table_id").cast("int").alias("table_id"), "hash", "doc_id", "tok")


CACHE = "query_key string, cells long, fde array<double>"


def cached_encodings(queries: DataFrame, path: str, length: int, build) -> DataFrame:
    """qid, fde of queries(qid, query_key), from the cache at ``path`` where it has an encoding of ``length`` values
    under a query's key; the others (new ones, or of another length) are built by ``build(queries)`` and appended."""
    spark = queries.sparkSession

    def stored() -> DataFrame:
        rows = spark.read.schema(CACHE).parquet(path) if exists(spark, path) else spark.createDataFrame([], CACHE)
        return rows.where(F.col("cells") == length).groupBy("query_key").agg(F.first("fde").alias("fde"))

    todo = queries.join(stored().select("query_key"), "query_key", "left_anti")
    if not todo.isEmpty():
        fresh = build(todo).join(queries, "qid").select("query_key", F.size("fde").cast("long").alias("cells"), "fde")
        fresh.write.mode("append").parquet(path)
    return queries.join(stored(), "query_key").select("qid", "fde")


def save_pack(packed: DataFrame, path: str, ranges: int = 200) -> None:
    """Token rows sorted by document within ranges, so that row groups are skipped by doc_id and tok."""
    packed.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "tok").write.mode("overwrite").parquet(path)


def read_span(spark: SparkSession, path: str, doc_id: int, first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` of a document, by predicates that reach the scan."""
    return spark.read.parquet(path).where((F.col("doc_id") == doc_id) & F.col("tok").between(first, last))


# Truths: appended once per query


TRUTH = "qid long, doc_id long, score double, rank long"


def read_truth(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """Stored truth, best k of each query by score; rows stored twice count once. Nothing stored: no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], TRUTH)
    rows = spark.read.schema(TRUTH).parquet(path).select("qid", "doc_id", "score").distinct()
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")).cast("long"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def append_truth(qtokens: DataFrame, path: str, compute) -> int:
    """Stores ``compute(qtokens)`` (qid, doc_id, score, rank) of queries not stored yet; returns how many there were."""
    spark = qtokens.sparkSession
    todo = qtokens.join(read_truth(spark, path).select("qid").distinct(), "qid", "left_anti")
    n = todo.select("qid").distinct().count()
    if n:
        compute(todo).select("qid", "doc_id", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank")).write.mode("append").parquet(path)
    return n


# Reports


LATENCY = ("qid", "ann_ms", "rerank_ms", "rerank_compute_ms", "rerank_io_ms", "wait_ms", "dup_ratio", "read_bytes", "minflt", "majflt", "docloads", "uniqdocs", "mean_pos_delta", "p95_pos_delta")


def latency_rows(measured: DataFrame, batch: int = 1) -> DataFrame:
    """The 14 columns of the latency log from measurements in seconds (ann_s of a batch of ``batch`` queries; ann_s,
    rerank_s, rerank_compute_s, rerank_io_s, wait_s): milliseconds, and -1 where nothing was measured."""
    have = set(measured.columns)

    def column(name: str):
        source = name[:-3] + "_s" if name.endswith("_ms") else name
        if source not in have:
            return F.lit(-1.0).alias(name)
        value = F.col(source) * (1000.0 / (batch if name == "ann_ms" else 1)) if name.endswith("_ms") else F.col(source)
        return value.alias(name) if name == "qid" else F.coalesce(value.cast("double"), F.lit(-1.0)).alias(name)

    return measured.select(*map(column, LATENCY))


def write_table(df: DataFrame, path: str, append: bool = False, one_file: bool = True) -> None:
    """CSV with a header; tab-separated if the path ends in .tsv. Reports are small: one file unless told otherwise."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("append" if append else "overwrite").option("header", True).option("sep", "\t" if path.rstrip("/").endswith(".tsv") else ",").csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    """One JSON object a row, such as a row per retriever."""
    rows.coalesce(1).write.mode("overwrite").json(path)
