"""Ablations as parameters of one plan: every setting is a label that rides through the join instead of a run."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.config import FdeConfig, Fill
from . import metrics
from .encode import ablated_blocks, blocks
from .search import fde_scores, topk


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def labelled_metrics(ranked: DataFrame, qrels: DataFrame, label: str, labels: list, k: int) -> DataFrame:
    """label, recall, ndcg at k of several rankings at once: the label becomes part of the query's id."""
    name = F.struct(F.col(label).alias("label"), F.col("qid").alias("q"))
    rel = qrels.withColumn(label, F.explode(F.array(*map(F.lit, labels)))).select(name.alias("qid"), "doc_id", "rel")
    per = metrics.per_query(ranked.select(name.alias("qid"), "doc_id", "rank"), rel, k)
    return per.groupBy(F.col("qid.label").alias(label)).agg(F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"))


def bit_ablation(tokens: DataFrame, qtokens: DataFrame, qrels: DataFrame, cfg: FdeConfig, k: int = 10) -> DataFrame:
    """bit, forced, recall, ndcg, recall_drop, ndcg_drop: documents encoded with one bit forced, queries as they are.

    Forcing a bit concerns the partition alone; what fills empty partitions is still compared by the tokens' own bits.
    """
    q = blocks(qtokens, cfg.query(), "qid")
    runs = [(-1, None, 0), *((2 * b + v, b, v) for b in range(cfg.bits) for v in (0, 1))]
    if cfg.fill is Fill.NONE:
        found = fde_scores(q, ablated_blocks(tokens, cfg, runs), cfg.width, by=("run",))
    else:
        found = _union([fde_scores(q, blocks(tokens, replace(cfg, forced_bit=b, forced_value=v), together=True).withColumn("run", F.lit(run)), cfg.width, by=("run",)) for run, b, v in runs])
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("run", "qid").orderBy(F.desc("score"), "doc_id")).cast("long")).where(F.col("rank") <= k)
    got = labelled_metrics(ranked, qrels, "run", [r for r, _, _ in runs], k)
    # A row for each setting: the full encoding's figures reach the others without computing anything twice.
    one = got.groupBy().agg(F.max_by(F.struct("recall", "ndcg"), F.col("run") == -1).alias("full"), F.collect_list(F.struct("run", "recall", "ndcg")).alias("e"))
    some = one.select("full", F.explode("e").alias("e")).where("e.run >= 0")
    return some.select(
        F.floor(F.col("e.run") / 2).cast("long").alias("bit"),
        (F.col("e.run") % 2).cast("long").alias("forced"),
        "e.recall",
        "e.ndcg",
        (F.col("full.recall") - F.col("e.recall")).alias("recall_drop"),
        (F.col("full.ndcg") - F.col("e.ndcg")).alias("ndcg_drop"),
    )


def ablation_summary(drops: DataFrame) -> DataFrame:
    """forced (-1: both), mean drops, their population deviation, and the bit of the largest recall drop."""
    every = drops.unionByName(drops.withColumn("forced", F.lit(-1).cast("long")))
    return every.groupBy("forced").agg(F.avg("recall_drop").alias("mean_recall_drop"), F.avg("ndcg_drop").alias("mean_ndcg_drop"), F.stddev_pop("recall_drop").alias("std_recall_drop"), F.min_by("bit", F.struct(-F.col("recall_drop"), F.col("bit"))).alias("worst_bit"))


def repetition_scores(queries: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """rep, qid, doc_id, score of every repetition alone: one more grouping key."""
    return fde_scores(queries, docs, width, by=("rep",))


def repetition_ablation(queries: DataFrame, docs: DataFrame, width: int, qrels: DataFrame, reps: int, k: int = 10) -> DataFrame:
    """rep, recall, ndcg with only that repetition."""
    scored = repetition_scores(queries, docs, width)
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("rep", "qid").orderBy(F.desc("score"), "doc_id")).cast("long")).where(F.col("rank") <= k)
    return labelled_metrics(ranked, qrels, "rep", list(range(reps)), k)


def top_repetitions(per_rep: DataFrame, reps: int, percents: tuple[int, ...] = (20, 40, 60, 80), by: str = "recall") -> DataFrame:
    """percent, rep: the best share of repetitions by a metric, one at least, the smaller number of equals."""
    ranked = per_rep.withColumn("place", F.row_number().over(W.orderBy(F.desc(by), "rep")))  # one row per repetition
    return _union([ranked.where(F.col("place") <= max(1, reps * p // 100)).select(F.lit(p).alias("percent"), "rep") for p in percents])


def combined_repetitions(queries: DataFrame, docs: DataFrame, width: int, qrels: DataFrame, chosen: DataFrame, percents: tuple[int, ...] = (20, 40, 60, 80), k: int = 10) -> DataFrame:
    """percent, recall, ndcg with the chosen repetitions of each percentage together."""
    scored = repetition_scores(queries, docs, width).join(F.broadcast(chosen), "rep").groupBy("percent", "qid", "doc_id").agg(F.sum("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("percent", "qid").orderBy(F.desc("score"), "doc_id")).cast("long")).where(F.col("rank") <= k)
    return labelled_metrics(ranked, qrels, "percent", [int(p) for p in percents], k)


def grid(tokens: DataFrame, qtokens: DataFrame, qrels: DataFrame, configs: dict[str, FdeConfig], k: int = 10) -> DataFrame:
    """setting, recall, ndcg of several encodings, one plan for all."""
    runs = []
    for name, cfg in configs.items():
        found = fde_scores(blocks(qtokens, cfg.query(), "qid"), blocks(tokens, cfg.document(), together=True), cfg.width)
        runs.append(topk(found, k).withColumn("setting", F.lit(name)))
    return labelled_metrics(_union(runs), qrels, "setting", list(configs), k)
