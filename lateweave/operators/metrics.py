"""Evaluation of ranked(qid, doc_id, rank, ..) against relevance judgements or a brute-force truth.

Judgements are qrels(qid, doc_id, rel); rel > 0 is relevant. Queries without a relevant document don't count. All are
equi-joins on (qid, doc_id) after cutting both sides to k, so they grow with queries times k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _gain(rel: Column) -> Column:
    return F.pow(F.lit(2.0), rel) - 1


def per_query(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """qid, hit, recall, ndcg at k for every query with relevant documents, whether or not it was answered."""
    order = W.partitionBy("qid").orderBy(F.desc("rel"), F.asc("doc_id"))
    good = qrels.where("rel > 0").select("qid", "doc_id", "rel").withColumn("place", F.row_number().over(order))
    top = ranked.where(F.col("rank") <= k).select("qid", "doc_id", "rank")
    met = good.join(top, ["qid", "doc_id"], "left")
    found = F.col("rank").isNotNull()
    ideal = F.sum(F.when(F.col("place") <= k, _gain(F.col("rel")) / F.log2(F.col("place") + 1.0)))
    got = F.coalesce(F.sum(F.when(found, _gain(F.col("rel")) / F.log2(F.col("rank") + 1.0))), F.lit(0.0))
    return met.groupBy("qid").agg(
        F.max(found.cast("double")).alias("hit"),
        F.avg(found.cast("double")).alias("recall"),
        F.when(ideal > 0, got / ideal).otherwise(0.0).alias("ndcg"),
    )


def evaluate(ranked: DataFrame, qrels: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, queries, hit_at_k, recall_at_k, ndcg_at_k: means over queries with relevant documents; 0 without any.

    hit_at_k is the share of queries with any relevant document among the first k, recall_at_k the mean share found.
    """
    out = None
    for k in ks:
        mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
        one = per_query(ranked, qrels, k).agg(F.count("*").alias("queries"), mean("hit").alias("hit_at_k"), mean("recall").alias("recall_at_k"), mean("ndcg").alias("ndcg_at_k"))
        one = one.select(F.lit(k).cast("long").alias("k"), "*")
        out = one if out is None else out.union(one)
    return out


def summary(per: DataFrame) -> DataFrame:
    """metric, min, avg, max of per-query recall and ndcg."""
    wide = per.agg(*(f(c).alias(f"{c}_{f.__name__}") for c in ("recall", "ndcg") for f in (F.min, F.avg, F.max)))
    rows = [F.struct(F.lit(c).alias("metric"), *(F.col(f"{c}_{f}").alias(f) for f in ("min", "avg", "max"))) for c in ("recall", "ndcg")]
    return wide.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def per_query_truth(ranked: DataFrame, truth: DataFrame, k: int, driver: str = "truth") -> DataFrame:
    """qid, recall, hit, ndcg against truth(qid, doc_id, score, rank). Gains are truth scores, at least 0.

    driver: ``truth`` counts every query of the truth (unanswered: 0), ``system`` every answered query that has truth.
    """
    t = truth.where(F.col("rank") <= k).select("qid", "doc_id", F.greatest("score", F.lit(0.0)).alias("gain"), F.col("rank").alias("place"))
    s = ranked.where(F.col("rank") <= k).select("qid", "doc_id", "rank")
    if driver == "system":
        t = t.join(s.select("qid").distinct(), "qid", "left_semi")
    met = t.join(s, ["qid", "doc_id"], "left")
    found = F.col("rank").isNotNull()
    ideal = F.sum(F.col("gain") / F.log2(F.col("place") + 1.0))
    got = F.coalesce(F.sum(F.when(found, F.col("gain") / F.log2(F.col("rank") + 1.0))), F.lit(0.0))
    return met.groupBy("qid").agg(
        F.avg(found.cast("double")).alias("recall"),
        F.max(found.cast("double")).alias("hit"),
        F.when(ideal > 0, got / ideal).otherwise(0.0).alias("ndcg"),
    )


def evaluate_truth(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...], driver: str = "truth") -> DataFrame:
    """k, queries, recall_at_k, hit_at_k, ndcg_at_k against a truth."""
    out = None
    for k in ks:
        mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
        one = per_query_truth(ranked, truth, k, driver).agg(F.count("*").alias("queries"), mean("recall").alias("recall_at_k"), mean("hit").alias("hit_at_k"), mean("ndcg").alias("ndcg_at_k"))
        one = one.select(F.lit(k).cast("long").alias("k"), "*")
        out = one if out is None else out.union(one)
    return out


def overlap(qrels: DataFrame, docs: DataFrame) -> DataFrame:
    """relevant, indexed, overlap: which share of the relevant documents is in the collection."""
    rel = qrels.where("rel > 0").select("doc_id").distinct()
    met = rel.join(docs.select("doc_id").distinct().withColumn("there", F.lit(1)), "doc_id", "left")
    n, m = F.count("*"), F.count("there")
    return met.agg(n.alias("relevant"), m.alias("indexed"), (m / F.greatest(n, F.lit(1))).alias("overlap"))
