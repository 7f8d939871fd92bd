"""Inverted lists over encodings, hash tables over tokens, packs of token rows, and learnt partition centers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import kept
from ..functions.vectors import BROADCAST_BYTES, checked_broadcast, dot, doubles, literal, norm, ranges_below, sign_bits
from ..plans.config import FdeConfig, gray_decode, kmeans_sample_ratio, lsh_planes, memory_sample_ratio
from .search import fde_scores, topk

#: Lists that one search may name in its filter.
MOST_LISTS = 10_000


# Inverted lists: list centers are blocks(qid = list, rep, part, vec) like queries, so that assigning is scoring


def assign_lists(centers: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """doc_id, list_id: the list of largest inner product, the smaller of equals, of every document that meets one."""
    return topk(fde_scores(centers, docs, width), 1, "doc_id", F.asc("qid")).select("doc_id", F.col("qid").alias("list_id"))


def probe_lists(queries: DataFrame, centers: DataFrame, width: int, nprobe: int) -> DataFrame:
    """qid, list_id of the nprobe nearest lists of every query."""
    found = fde_scores(queries, centers.withColumnRenamed("qid", "doc_id"), width)
    return topk(found, nprobe).select("qid", F.col("doc_id").alias("list_id"))


def ivf_search(queries: DataFrame, docs: DataFrame, lists: DataFrame, probes: DataFrame, width: int, k: int) -> DataFrame:
    """qid, doc_id, score, rank: the k best of the documents in the probed lists(doc_id, list_id)."""
    wanted = lists.join(probes, "list_id").select("qid", "doc_id")
    q = queries.select("qid", "rep", "part", F.col("vec").alias("q_vec"))
    met = docs.join(wanted, "doc_id").join(q, ["qid", "rep", "part"])
    scores = met.select("qid", "doc_id", dot(F.col("vec"), F.col("q_vec")).alias("s")).groupBy("qid", "doc_id").agg(F.sum("s").alias("score"))
    every = wanted.join(scores, ["qid", "doc_id"], "left").select("qid", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return topk(every, k)


def stored_search(queries: DataFrame, postings: DataFrame, probes: DataFrame, width: int, k: int) -> DataFrame:
    """qid, doc_id, score, rank as :func:`ivf_search`, from postings(list_id, doc_id, rep, part, vec): the encodings
    themselves, stored by list (``store.save_lists``). Only the folders of probed lists are read, of which there are at
    most ``MOST_LISTS``; a document's blocks lie in one list, so its scores add up from one folder.
    """
    named = [r[0] for r in probes.select("list_id").distinct().limit(MOST_LISTS + 1).collect()]
    if len(named) > MOST_LISTS:
        raise ValueError(f"more than {MOST_LISTS} lists probed; split the query set")
    read = postings.where(F.col("list_id").isin(named)) if named else postings.limit(0)
    wanted = checked_broadcast(probes.select(F.col("list_id").alias("p_list"), F.col("qid").alias("p_qid")), 16)
    q = checked_broadcast(queries.select("qid", F.col("rep").alias("q_rep"), F.col("part").alias("q_part"), F.col("vec").alias("q_vec")), 32 + 8 * width)
    met = read.join(wanted, F.col("list_id") == F.col("p_list")).join(q, (F.col("p_qid") == F.col("qid")) & (F.col("rep") == F.col("q_rep")) & (F.col("part") == F.col("q_part")), "left")
    scores = met.groupBy(F.col("p_qid").alias("qid"), "doc_id").agg(F.sum(F.coalesce(dot(F.col("vec"), F.col("q_vec")), F.lit(0.0))).alias("score"))
    return topk(scores, k)


def hashed_share(df: DataFrame, share: float, seed: int, *by: str) -> DataFrame:
    """About ``share`` of the rows, the same ones on each run: a filter by the hash of their keys, without a shuffle."""
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 24)) < int(share * (1 << 24)))


def train_lists(dense: DataFrame, cfg: FdeConfig, lists: int, seed: int = 42, sample: int | None = None) -> DataFrame:
    """Centers as blocks(qid = list, rep, part, vec), by k-means over dense encodings(doc_id, fde).

    Trained on about ``sample`` documents (max(100 per list, 50,000) if None), chosen by the hash of their ids.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if 8 * lists * cfg.length > BROADCAST_BYTES:
        raise ValueError("the centers of so many lists are too large for one model; lower lists or the encoding's length")
    some = hashed_share(dense, (sample or max(100 * lists, 50_000)) / max(1, dense.count()), seed, "doc_id")
    model = KMeans(k=lists, seed=seed, maxIter=20, tol=1e-4).fit(some.select(array_to_vector(doubles(F.col("fde"))).alias("features")))
    rows = [(i, c.reshape(-1, cfg.width)) for i, c in enumerate(map(np.asarray, model.clusterCenters()))]
    cells = [(i, r // cfg.partitions, r % cfg.partitions, v.tolist()) for i, c in rows for r, v in enumerate(c) if v.any()]
    return dense.sparkSession.createDataFrame(cells, "qid long, rep int, part int, vec array<double>")


# Learnt centers for partitions


def train_centers(tokens: DataFrame, cfg: FdeConfig, ratio: float | None = None, seed: int | None = None, memory_gb: float = 2.0) -> np.ndarray:
    """[reps, partitions, dimension] centers by k-means, each repetition on its own sample of tokens.

    The sample is about a share ``ratio`` of the tokens, about two per center at least; it stays distributed. Without
    a ratio it grows with the number of partitions, as far as points and centers fit ``memory_gb``.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    base = cfg.seed if seed is None else seed
    n = max(1, tokens.count())
    if ratio is None:
        ratio = min(kmeans_sample_ratio(cfg.bits), memory_sample_ratio(n, cfg.dimension, cfg.partitions, memory_gb, 1))
    share = max(ratio, 2 * cfg.partitions / n)
    out = []
    for r in range(cfg.reps):
        some = hashed_share(tokens, share, base + r, "doc_id", "tok")
        model = KMeans(k=cfg.partitions, seed=base + r, initMode="k-means||", maxIter=20, tol=1e-3).fit(some.select(array_to_vector(doubles(F.col("vec"))).alias("features")))
        found = np.stack([np.asarray(c) for c in model.clusterCenters()])
        if len(found) < cfg.partitions:  # fewer distinct tokens than partitions: the rest is never nearest
            found = np.concatenate([found, np.repeat(found[:1], cfg.partitions - len(found), 0)])
        out.append(found)
    return np.stack(out)


def train_pca(tokens: DataFrame, cfg: FdeConfig, axes: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Components [reps, axes, dimension] and centers [reps, partitions, axes] from the tokens' principal axes.

    The second moments of all tokens are summed by Spark; the driver gets dimension^2 numbers. A partition's center
    lies half a deviation above or below the median of each of the first ``bits`` axes, by the bits its number decodes
    to. Axes are those of largest variance, signs such that the largest entry of each is positive. Projecting doesn't
    subtract the mean; centers are of projections that do. Medians are exact. All repetitions are alike.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    axes = min(axes, cfg.dimension)
    vec = doubles(F.col("vec"))
    model = PCA(k=axes, inputCol="features", outputCol="out").fit(tokens.select(array_to_vector(vec).alias("features")))
    parts = np.array(model.pc.toArray()).T
    parts *= np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(1)])[:, None]
    used = min(cfg.bits, axes)
    projected = [dot(literal(parts[k]), vec).alias(f"a{k}") for k in range(used)]
    from .stats import exact_quantiles

    shown = kept(tokens.select(*projected)) if used else tokens
    stats = shown.agg(*(f(F.col(f"a{k}")) for k in range(used) for f in (F.stddev_pop, F.avg))).first() if used else ()
    middle = {r["column_name"]: r["value"] for r in exact_quantiles(shown, [f"a{k}" for k in range(used)], [0.5]).collect()} if used else {}
    centers = np.zeros((cfg.partitions, axes))
    for p in range(cfg.partitions):
        bits = gray_decode(p)
        for k in range(used):
            median, (deviation, mean) = middle[f"a{k}"], stats[2 * k : 2 * k + 2]
            centers[p, k] = median - mean + (0.5 if bits >> k & 1 else -0.5) * deviation
    return np.repeat(parts[None], cfg.reps, 0), np.repeat(centers[None], cfg.reps, 0)


def pca_dimensions(tokens: DataFrame, axes: int = 20, most: int = 10) -> list[tuple[int, float]]:
    """(dimension, score) of the dimensions that the principal axes load most on: sums of absolute loadings weighted by
    each axis' share of variance; the smaller dimension of equals. The driver gets dimension x axes numbers."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    one = tokens.select(F.size("vec")).first()
    if one is None:
        return []
    model = PCA(k=min(axes, one[0]), inputCol="features", outputCol="out").fit(tokens.select(array_to_vector(doubles(F.col("vec"))).alias("features")))
    score = np.abs(model.pc.toArray()) @ model.explainedVariance.toArray()
    return [(int(d), float(score[d])) for d in sorted(range(len(score)), key=lambda d: (-score[d], d))[:most]]


# Hash tables over tokens


def lsh_hashes(tokens: DataFrame, dimension: int, bits: int = 64, tables: int = 4, seed: int = 42) -> DataFrame:
    """table_id, hash, doc_id, tok for every token and table; a product of 0 is bit 1. 64 bits are a signed long."""
    if not 1 <= bits <= 64:
        raise ValueError("a hash has 1 to 64 bits")
    vec = doubles(F.col("vec"))
    each = F.posexplode(F.transform(literal(lsh_planes(dimension, bits, tables, seed)), lambda p: sign_bits(vec, p, 1)))
    return tokens.select("doc_id", "tok", each.alias("table_id", "hash")).select("table_id", "hash", "doc_id", "tok")


def lsh_probe(hashes: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, doc_id, hits: in how many (table, query token, token) a document shares a hash with the query."""
    q = queries.select("table_id", "hash", F.col("doc_id").alias("qid"))
    return hashes.join(q, ["table_id", "hash"]).groupBy("qid", "doc_id").agg(F.count("*").alias("hits"))


# Packs: rows of all documents one after the other, in blocks that don't cross documents


def pack(tokens: DataFrame, block_size: int) -> DataFrame:
    """doc_id, tok, block, row, vec: block counts from 0 in each document; row from 0 over all, by doc_id and tok.

    Rows are numbered by offsets of documents' sizes, so only one number per document is ordered globally.
    """
    n = tokens.groupBy("doc_id").agg(F.count("*").alias("n"))
    starts = offsets(n, "doc_id", "n").select("doc_id", "start")
    return tokens.join(starts, "doc_id").select("doc_id", "tok", F.floor(F.col("tok") / block_size).cast("long").alias("block"), (F.col("start") + F.col("tok")).alias("row"), "vec")


def offsets(sizes: DataFrame, id_col: str, size_col: str, ranges: int = 1024) -> DataFrame:
    """``sizes`` with start, the sum of all sizes before it by id. Ids are cut into ranges at quantiles; only the
    ranges' sums meet in one task, and what is ordered within a task is a range."""
    quantiles = sizes.agg(F.percentile_approx(id_col, F.array(*(F.lit(k / ranges) for k in range(1, ranges))), 10 * ranges).alias("q")).first()["q"] or []
    splits = sorted(set(quantiles))
    parted = sizes.withColumn("__range", ranges_below(F.col(id_col), splits, "bigint"))
    running = lambda w: F.coalesce(F.sum(w[1]).over(w[0].rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = parted.groupBy("__range").agg(F.sum(size_col).alias("__sum"))
    before = per.select("__range", running((W.orderBy("__range"), "__sum")).alias("__before"))
    inner = running((W.partitionBy("__range").orderBy(id_col), size_col))
    return parted.withColumn("__inner", inner).join(before, "__range").select(*sizes.columns, (F.col("__inner") + F.col("__before")).cast("long").alias("start"))


def block_norms(tokens: DataFrame, block_size: int) -> DataFrame:
    """doc_id, block, n_rows, max_norm."""
    t = tokens.select("doc_id", F.floor(F.col("tok") / block_size).cast("long").alias("block"), norm(doubles(F.col("vec"))).alias("v"))
    return t.groupBy("doc_id", "block").agg(F.count("*").alias("n_rows"), F.max("v").alias("max_norm"))


def row_spans(rows: DataFrame, by: str = "doc_id", row: str = "tok") -> DataFrame:
    """by, start, length: runs of consecutive rows, repeats counted once."""
    island = F.col(row) - F.row_number().over(W.partitionBy(by).orderBy(row))
    return rows.select(by, row).distinct().withColumn("island", island).groupBy(by, "island").agg(F.min(row).alias("start"), F.count("*").alias("length")).drop("island")
