"""Document fingerprints by consistent weighted sampling.

A document is a bag of lower-case words, each weighted by how often it occurs. For every slot a word has r and c from
Gamma(2, 1) and b uniform, all functions of (word, slot). With weight w, t = floor(ln w / r + b), y = exp(r (t - b)) and
a = c / (y e^r); the slot's sample is the (word, t) of least a. Two documents agree in a slot with a probability equal
to the generalised Jaccard similarity of their bags, sum of minima over sum of maxima, so the share of equal slots
estimates it. A slot keeps 16 bits of its sample. Gamma variates come from the inverse distribution function at 65536
equal steps.

Equal texts have equal fingerprints. Texts without a word share one fingerprint of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, mix, partitions, prefix_hashes, range_of, raw, span_hashes, text_frame, words

SLOTS = 128


@lru_cache(maxsize=1)
def gamma_steps() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at the middles of 65536 equal steps of probability, and its logarithm."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(len(p)), np.full(len(p), 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low.astype(np.float32), np.log(low).astype(np.float32)


def signatures(buf: np.ndarray, at: np.ndarray, slots: int = SLOTS, seed: int = 42) -> np.ndarray:
    """[texts, slots] 16-bit samples."""
    n = len(at) - 1
    start, end, doc = words(buf, at)
    out = np.zeros((n, slots), np.uint16)
    if not len(start):
        return out
    h = span_hashes(prefix_hashes(LOWER[buf]), start, end)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    weight = np.diff(np.append(first, len(h)))
    h, doc = h[first], doc[first]
    # A sample's rank depends on word and weight only: computed once for each such pair of the block.
    _, one, pair = np.unique(mix(h) + weight.astype(U64), return_index=True, return_inverse=True)
    word, log_w = h[one], np.log(weight[one]).astype(np.float32)
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    steps, logs = gamma_steps()
    for k in range(slots):
        z = mix(word ^ U64((0x9E3779B97F4A7C15 * (k + 1) + seed) & 0xFFFFFFFFFFFFFFFF))
        r, c = steps[z & U64(0xFFFF)], logs[(z >> U64(16)) & U64(0xFFFF)]
        b = ((z >> U64(32)) & U64(0xFFFF)).astype(np.float32) / np.float32(65536)
        t = np.floor(log_w / r + b)
        a = (c - r * (t - b) - r).view(np.int32)
        rank = (a ^ ((a >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) + (1 << 31)
        sample = ((z >> U64(48)) ^ (t.astype(np.int64).astype(U64) * U64(40503))) & U64(0xFFFF)
        out[doc[heads], k] = (np.minimum.reduceat(((rank.astype(U64) << U64(16)) | sample)[pair], heads) & U64(0xFFFF)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def _hex(sig: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in sig.astype(">u2")]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, fingerprint for every row; null is empty, ids and repeats are kept."""
    from .common import blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, at in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(_hex(signatures(buf, at, slots)))], ["doc_id", "fingerprint"])

    return text_frame(df, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def splits_of(df: DataFrame, n: int) -> list[int]:
    """Up to 3 n - 1 values of doc_id that cut the rows into about equal ranges."""
    steps = [k / (3 * n) for k in range(1, 3 * n)]
    return sorted(set(df.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, steps)), F.lit(30 * n)).alias("q")).first()["q"] or []))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, ghost, doc_id, text: the rows dealt to ranges of descending ids (null last) and sorted there, each range
    followed by a ghost of the row that comes next; after the last range, the first row of all.

    A range is a task. Only ids are read to find the ranges; one id for each range goes to the driver and back. Texts are shuffled once.
    """
    spark = df.sparkSession
    docs = text_frame(df, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    splits = splits_of(docs, n)
    # Descending: the range of an id is the number of splits not below it.
    above = len(splits) - range_of(F.col("doc_id"), splits)
    part = F.when(F.col("doc_id").isNull(), len(splits) + 1).otherwise(above).cast("int")
    docs = docs.withColumn("part", part)
    heads = sorted((r["part"], r["head"]) for r in docs.groupBy("part").agg(F.max("doc_id").alias("head")).collect())
    follow = [(heads[(k + 1) % len(heads)][1], p) for k, (p, _) in enumerate(heads)]
    ghosts = spark.createDataFrame(follow, "head long, part int")
    ghost_rows = docs.drop("part").join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("head"))).select("part", F.lit(True).alias("ghost"), "doc_id", "text")
    every = docs.select("part", F.lit(False).alias("ghost"), "doc_id", "text").union(ghost_rows)
    return every.repartitionById(len(splits) + 2, "part").sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), "text")


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, block: int = 1 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, a row for each row.

    The edited text has its last third (rounded down, in code points) replaced by the first as many code points of
    the next document in descending order of doc_id (null last, ties by text). Null texts are empty; a table of one
    row is its own next; an empty table gives none.
    """

    def out(rows: list[tuple[int | None, str]], ahead: str) -> pa.RecordBatch:
        texts = [t for _, t in rows] + [ahead]
        cuts = [len(t) // 3 for t in texts[:-1]]
        edited = [t[: len(t) - c] + u[:c] for t, u, c in zip(texts, texts[1:], cuts, strict=False)]
        sig = signatures(*raw(pa.array(texts + edited, pa.large_string())), slots)
        mine, nxt, other = sig[: len(rows)], sig[1 : len(rows) + 1], sig[len(rows) + 1 :]
        columns = [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(_hex(mine)), pa.array(_hex(other)), pa.array(likeness(mine, other)), pa.array(likeness(mine, nxt))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int | None, str]] = []
        size, over = 0, None
        for batch in batches:
            for part, ghost, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if part == over:
                    continue  # further rows that tie with the ghost
                text = text.as_py()
                if ghost or size > block:
                    if rows:
                        yield out(rows, text)
                    rows, size = [], 0
                    if ghost:
                        over = part
                        continue
                rows.append((i, text))
                size += len(text)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(df, id_col, text_col).mapInArrow(run, schema)
