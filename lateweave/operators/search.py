"""First-stage search over encodings and re-ranking by Chamfer (MaxSim) similarity.

Queries are the small side everywhere: a stated set, taken in blocks if it is large. Documents are never compared with
each other, and top-k is taken by a window that Spark turns into a limit per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import kept
from ..functions.vectors import checked_broadcast, checked_local, checked_rows, dot, doubles, elementwise

#: What an empty document scores.
EMPTY_SCORE = -1e9
#: Query tokens (or query encodings) whose products one pass over the documents keeps.
BLOCK = 512


def fde_scores(queries: DataFrame, docs: DataFrame, width: int, every: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """qid, doc_id, score (after columns ``by`` of the documents): inner products of query blocks(qid, rep, part, vec)
    and document blocks.

    An equi-join on the partition, so empty partitions cost nothing. Pairs without a common partition are left out
    unless ``every(qid, doc_id)`` lists the pairs wanted; they score 0. If all blocks of a document are in one task
    (``encode.blocks(.., together=True)``), nothing is shuffled here.
    """
    q = checked_broadcast(queries.select("qid", F.col("rep").alias("q_rep"), F.col("part").alias("q_part"), F.col("vec").alias("q_vec")), 32 + 8 * width)
    met = docs.join(q, (F.col("rep") == F.col("q_rep")) & (F.col("part") == F.col("q_part")))
    found = met.select(*by, "qid", "doc_id", dot(F.col("vec"), F.col("q_vec")).alias("s")).groupBy(*by, "qid", "doc_id").agg(F.sum("s").alias("score"))
    if every is None:
        return found
    return every.join(found, ["qid", "doc_id"], "left").select("qid", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def topk(scores: DataFrame, k: int | None, by: str = "qid", then: Column | None = None) -> DataFrame:
    """``scores`` with rank (from 1, by descending score, then ``then`` or doc_id), up to k rows a query; None: all."""
    order = [F.desc("score"), then if then is not None else F.asc("doc_id")]
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def full_ranking(scores: DataFrame, ranges: int = 64) -> DataFrame:
    """As :func:`topk` without a limit, for rankings of whole collections: the scores of a query are cut into ranges at
    their quantiles, ranked within a range, and offset by how many stand in the ranges before."""
    scores = kept(scores)
    shares = F.array(*(F.lit(k / ranges) for k in range(1, ranges)))
    splits = scores.groupBy("qid").agg(F.percentile_approx("score", shares, F.lit(10 * ranges)).alias("splits"))
    placed = scores.join(checked_broadcast(splits, 16 + 8 * ranges), "qid").withColumn("range", F.size(F.filter("splits", lambda s: s > F.col("score")))).drop("splits")
    before = F.coalesce(F.sum("n").over(W.partitionBy("qid").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = placed.groupBy("qid", "range").agg(F.count("*").alias("n")).select("qid", "range", before.alias("before"))
    within = F.row_number().over(W.partitionBy("qid", "range").orderBy(F.desc("score"), F.asc("doc_id")))
    ranked = placed.withColumn("rank", within).join(offset, ["qid", "range"])
    return ranked.select(*scores.columns, (F.col("rank") + F.col("before")).cast("long").alias("rank"))


def scan_topk(queries: DataFrame, docs: DataFrame, k: int, vec: str = "fde") -> DataFrame:
    """qid, doc_id, score, rank by one pass over dense encodings docs(doc_id, fde) for a set of dense queries(qid, fde).

    Blocks of queries are matrices that tasks multiply batches of documents with; a task hands on k rows a query at
    most (those that tie with its last by score and come later by id can't be among the first k of all). Documents are
    read once, however many blocks there are. The queries must fit the driver, which is checked.
    """
    one = queries.select(F.size(vec)).first()
    rows = checked_rows(queries.select("qid", doubles(F.col(vec)).alias("v")).orderBy("qid"), 16 + 8 * (one[0] if one else 1))
    if not rows.num_rows:
        return docs.limit(0).select(F.lit(0).cast("long").alias("qid"), "doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
    ids, flat = rows["qid"].to_pylist(), rows["v"].combine_chunks().flatten().to_numpy()
    matrix = flat.reshape(len(ids), -1)
    found = docs.select("doc_id", doubles(F.col(vec)).alias("v")).mapInArrow(_scan(ids, matrix, k), "qid long, doc_id long, score double")
    return topk(found, k)


def _scan(ids: list[int], matrix: np.ndarray, k: int):
    names = [np.array(ids[at : at + BLOCK], np.int64) for at in range(0, len(ids), BLOCK)]

    def best(doc: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of [documents, queries] the k first of each query: ids and scores, [k, queries]."""
        order = np.stack([np.lexsort((doc[:, j], -score[:, j]))[:k] for j in range(score.shape[1])], 1)
        return np.take_along_axis(doc, order, 0), np.take_along_axis(score, order, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [matrix[at : at + BLOCK].T.copy() for at in range(0, len(ids), BLOCK)]
        held = [(np.zeros((0, len(n)), np.int64), np.zeros((0, len(n)))) for n in names]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, d = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), batch.column(0).to_numpy()[:, None]
            for b, block in enumerate(blocks):
                s = rows @ block
                held[b] = best(np.concatenate([held[b][0], np.broadcast_to(d, s.shape)]), np.concatenate([held[b][1], s]))
        for n, (doc, score) in zip(names, held, strict=True):
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(n, len(doc))), pa.array(doc.ravel()), pa.array(score.ravel())], ["qid", "doc_id", "score"])

    return run


def chamfer(pairs: DataFrame, qtokens: DataFrame, tokens: DataFrame) -> DataFrame:
    """The columns of ``pairs(qid, doc_id, ..)`` with score: for every query token the largest product with a token of
    the document, summed over the query's tokens. A document without tokens scores ``EMPTY_SCORE``.

    Pairs and query bags are the stated, small side: they go to where the tokens are if a count shows that they fit,
    so tokens aren't shuffled (a filter by doc_id, in a pack its row groups). Maxima are combined per query token before
    and after the shuffle, so a document of very many tokens takes no more memory than another.
    """
    q = checked_broadcast(qtokens.groupBy("qid").agg(F.collect_list(doubles(F.col("vec"))).alias("bag")), 1 << 16)
    keys = checked_broadcast(pairs.select("qid", "doc_id").distinct(), 16)
    met = tokens.select(F.col("doc_id").alias("t_doc"), doubles(F.col("vec")).alias("vec")).join(keys, F.col("t_doc") == F.col("doc_id")).join(q, "qid")
    sims = met.select("qid", "doc_id", F.posexplode(F.transform("bag", lambda v: dot(v, F.col("vec")))).alias("qtok", "s"))
    score = sims.groupBy("qid", "doc_id", "qtok").agg(F.max("s").alias("m")).groupBy("qid", "doc_id").agg(F.sum("m").alias("score"))
    return pairs.join(score, ["qid", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(EMPTY_SCORE)))


def chamfer_all(qtokens: DataFrame, tokens: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, score of every document for a stated set of queries (exact truth).

    The query tokens are a matrix (in blocks of about ``BLOCK`` that don't cut a query). Tasks multiply batches of
    tokens with it and keep the maxima of each document they meet; what is shuffled is one row of maxima for a document
    and task. Documents of ``docs`` without tokens score ``EMPTY_SCORE``.
    """
    one = qtokens.select(F.size("vec")).first()
    rows = checked_rows(qtokens.select("qid", doubles(F.col("vec")).alias("v"), "qtok").orderBy("qid", "qtok"), 24 + 8 * (one[0] if one else 1))
    ids = np.array(rows["qid"].to_pylist(), np.int64)
    found = None
    start = 0
    while start < len(ids):
        stop = min(len(ids), start + BLOCK)
        if stop < len(ids):  # not within a query, unless it fills the block
            first = int(np.searchsorted(ids, ids[stop], "left"))
            stop = first if first > start else int(np.searchsorted(ids, ids[start], "right"))
        matrix = np.stack([np.asarray(v) for v in rows["v"].slice(start, stop - start).to_pylist()]).T.copy()
        n = stop - start
        part = tokens.select("doc_id", doubles(F.col("vec")).alias("vec")).mapInArrow(_maxima(matrix), "doc_id long, m array<double>")
        part = part.groupBy("doc_id").agg(elementwise("max", "m", n).alias("m"))
        names, heads = np.unique(ids[start:stop], return_index=True)
        ends = [*heads[1:].tolist(), n]
        sums = F.array(*(F.struct(F.lit(int(q)).cast("long").alias("qid"), F.aggregate(F.slice("m", int(a) + 1, int(b - a)), F.lit(0.0), lambda s, v: s + v).alias("score")) for q, a, b in zip(names, heads, ends, strict=True)))
        part = part.select("doc_id", F.explode(sums).alias("e")).select("e.qid", "doc_id", "e.score")
        found = part if found is None else found.union(part)
        start = stop
    if found is None:
        return tokens.limit(0).select(F.lit(0).cast("long").alias("qid"), "doc_id", F.lit(0.0).alias("score"))
    if docs is not None:
        bare = docs.select("doc_id").distinct().join(tokens.select("doc_id"), "doc_id", "left_anti")
        each = F.explode(F.array(*(F.lit(int(q)).cast("long") for q in np.unique(ids))))
        found = found.union(bare.select(each.alias("qid"), "doc_id", F.lit(EMPTY_SCORE).alias("score")))
    return found


def _maxima(matrix: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            s = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) @ matrix
            if (doc[1:] < doc[:-1]).any():
                order = np.argsort(doc, kind="stable")
                doc, s = doc[order], s[order]
            head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            top = np.maximum.reduceat(s, head, axis=0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(head) + 1) * s.shape[1], pa.int32()), pa.array(top.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(doc[head]), lists], ["doc_id", "m"])

    return run


def rerank(candidates: DataFrame, qtokens: DataFrame, tokens: DataFrame, n: int = 0, keep_tail: bool = True, k: int | None = None) -> DataFrame:
    """qid, doc_id, score, rank, stage from candidates(qid, doc_id, score, rank).

    The first ``n`` candidates of a query (0: all) are ordered by Chamfer similarity, equals in the order they came;
    the rest follow in their own order with their own scores unless ``keep_tail`` is off. Candidates are computed once
    if they are few enough to be held.
    """
    candidates, _ = checked_local(candidates.select("qid", "doc_id", "score", "rank"), 32)
    head = candidates if n == 0 else candidates.where(F.col("rank") <= n)
    scored = chamfer(head.select("qid", "doc_id", F.col("rank").alias("came")), qtokens, tokens).withColumn("stage", F.lit("rerank"))
    if keep_tail and n:
        tail = candidates.select("qid", "doc_id", F.col("rank").alias("came"), "score", F.lit("tail").alias("stage")).where(F.col("came") > n)
        scored = scored.unionByName(tail)
    order = [F.asc("stage"), F.when(F.col("stage") == "rerank", -F.col("score")), F.asc("came")]  # rerank before tail
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order)).cast("long"))
    ranked = ranked if k is None else ranked.where(F.col("rank") <= k)
    return ranked.select("qid", "doc_id", "score", "rank", "stage")


# Rows of a document that take part in re-ranking


def half_rows(tokens: DataFrame, policy: str = "front", size: int | None = None) -> DataFrame:
    """Half of every document's rows: the first, the last, or (stride2) a quarter from either end. At least one row;
    an unknown policy is ``front``. A row's place is its tok, which counts from 0 in each document.

    size: every document has so many places, taken or not, and the half is theirs; nothing is counted then, and the last
    half of a document that was cut short may be empty."""
    n = "n" if size is None else f"{size}"
    half, quarter = f"greatest(1, {n} div 2)", f"greatest(1, greatest(1, {n} div 2) div 2)"
    keep = {"back": f"tok >= {n} - {half}", "stride2": f"tok < {quarter} or tok >= {n} - {quarter}"}.get(policy, f"tok < {half}")
    counted = tokens if size is not None else tokens.join(tokens.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    return counted.where(F.expr(keep)).select(*tokens.columns)


def strongest_rows(tokens: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of largest norm of every document, the earlier of equals: a sketch of it."""
    from ..functions.vectors import norm

    order = W.partitionBy("doc_id").orderBy(F.desc("row_norm"), F.asc("tok"))
    ranked = tokens.withColumn("row_norm", norm(doubles(F.col("vec")))).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= most).select(*tokens.columns, "row_norm")


def duplicate_ratio(candidates: DataFrame, batch: str = "batch_id", n: int = 0) -> DataFrame:
    """batch_id, total_docs, unique_docs, dup_ratio over the first n candidates of the queries of a batch."""
    some = candidates if n == 0 else candidates.where(F.col("rank") <= n)
    got = some.groupBy(batch).agg(F.count("*").alias("total_docs"), F.countDistinct("doc_id").alias("unique_docs"))
    return got.withColumn("dup_ratio", 1 - F.col("unique_docs") / F.col("total_docs"))


def batches_of(queries: DataFrame, size: int, order: str = "qid") -> DataFrame:
    """``queries`` with batch_id: batches of ``size`` in order, the last may be smaller. For stated query sets only."""
    return queries.withColumn("batch_id", F.floor((F.row_number().over(W.orderBy(order)) - 1) / size).cast("long"))


def access_locality(ranked: DataFrame, position: Column | None = None) -> DataFrame:
    """qid, docloads, uniqdocs, mean_pos_delta, p95_pos_delta: how far apart documents read one after the other lie.

    The delta figures are null below two documents; p95 is the entry at the 95th percentile's lower place.
    """
    pos = position if position is not None else F.col("doc_id")
    step = F.abs(pos - F.lag(pos).over(W.partitionBy("qid").orderBy("rank")))
    got = ranked.withColumn("delta", step).groupBy("qid").agg(F.count("doc_id").alias("docloads"), F.countDistinct("doc_id").alias("uniqdocs"), F.avg("delta").alias("mean_pos_delta"), F.array_sort(F.collect_list("delta")).alias("deltas"))
    at = F.floor(0.95 * (F.size("deltas") - 1)).cast("int")
    return got.select("qid", "docloads", "uniqdocs", "mean_pos_delta", F.when(F.size("deltas") > 0, F.get("deltas", at)).cast("double").alias("p95_pos_delta"))
