"""Quality by ordinal regression on graded ratings.

A cumulative-link (proportional odds) model: P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector over
hashed text features, shared by all grades, and ordered thresholds. Features of a document are the words it holds
(lower case, hashed) and tokens for its shape (capitals, marks, digits, repetition, word length, in steps), hashed into
the same space; each counts once. Weights are kept sparse by a proximal step, so rare words of clean texts weigh
nothing. The model gives the expected grade and the probability of the top grade, by which documents are selected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, U64, blocks, mix, prefix_hashes, span_hashes, text_frame, words

BITS = 18
#: Steps of the shape features; a value's token is the number of steps below it.
STEPS = np.array([0.001, 0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])


def _class(codes: list[int]) -> np.ndarray:
    t = np.zeros(256, np.float64)
    t[codes] = 1
    return t


_CLASSES = [_class([*range(65, 91)]), _class([33, 63]), _class([*b"#$%&*@~^_|<>{}[]\\"]), _class([*range(48, 58)]), _class([10]), _class([*b".,;:"]), _class([*range(128, 256)])]


def features(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs of a block, each once, in order of document."""
    n = len(at) - 1
    start, end, doc = words(buf, at)
    size = np.maximum(1, np.diff(at)).astype(np.float64)
    h = span_hashes(prefix_hashes(LOWER[buf]), start, end)
    pair = np.unique((doc.astype(np.int64) << BITS) | (h >> U64(64 - BITS)).astype(np.int64))
    n_words = np.bincount(doc, minlength=n)
    distinct = np.bincount(pair >> BITS, minlength=n)
    shape = [np.add.reduceat(np.append(c[buf], 0.0), np.minimum(at[:-1], len(buf))) * (np.diff(at) > 0) / size for c in _CLASSES]
    shape += [distinct / np.maximum(1, n_words), np.bincount(doc, end - start, minlength=n) / np.maximum(1, n_words) / 20, np.log2(1 + n_words) / 20]
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1])) if len(doc) else doc
    shape.append(np.bincount(doc[same], minlength=n) / np.maximum(1, n_words))
    token = np.stack([mix((np.searchsorted(STEPS, s) + 100 * (k + 1)).astype(U64) + U64(1 << 40)) >> U64(64 - BITS) for k, s in enumerate(shape)], 1).astype(np.int64)
    pair = np.unique(np.concatenate([pair, ((np.arange(n) << BITS)[:, None] | token).ravel()]))
    return pair >> BITS, pair & ((1 << BITS) - 1)


@dataclass
class Ordinal:
    """weights by feature and thresholds, one fewer than grades; without thresholds nothing was learnt."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, self.weights[feature], minlength=n)

    def above(self, score: np.ndarray) -> np.ndarray:
        """[n, thresholds]: P(grade > k)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -40, 40)))


def fit(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, grades: int = 3, l1: float = 2e-4, rounds: int = 250, least: int = 4) -> Ordinal:
    """Proximal AdaGrad on the mean negative log-likelihood; features of fewer than ``least`` documents weigh nothing.

    Grades never seen among the rows leave their thresholds next to each other; the order of thresholds is kept by
    optimising the first and the logarithms of the steps.
    """
    n, w = len(grade), np.zeros(1 << BITS)
    if not n or len(np.unique(grade)) < 2:
        return Ordinal(w.astype(np.float32), np.zeros(0))
    used, column = np.unique(feature, return_inverse=True)
    count = np.bincount(column)
    good = (count >= least)[column]
    doc, column = doc[good], column[good]
    v, g2 = np.zeros(len(used)), np.full(len(used), 1e-8)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n, 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(grades - 1) * 1e-3)
    raw = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    t2 = np.full(len(raw), 1e-8)
    weight = n / np.maximum(1, np.bincount(grade, minlength=grades))
    weight = np.sqrt(weight / weight.min())[grade]
    weight /= weight.mean()
    for _ in range(rounds):
        steps = np.exp(raw[1:])
        theta = raw[0] + np.concatenate([[0.0], np.cumsum(steps)])
        s = np.bincount(doc, v[column], minlength=n)
        low = np.where(grade > 0, 1 / (1 + np.exp(np.clip(s - theta[np.maximum(grade - 1, 0)], -40, 40))), 0.0)
        high = np.where(grade < grades - 1, 1 / (1 + np.exp(np.clip(s - theta[np.minimum(grade, grades - 2)], -40, 40))), 1.0)
        p = np.maximum(high - low, 1e-12)
        a, b = high * (1 - high) / p * weight, low * (1 - low) / p * weight  # d log p / d threshold above, below
        ds = (a - b) / n
        grad = np.bincount(column, ds[doc], minlength=len(used))
        g2 += grad * grad
        rate = 0.3 / np.sqrt(g2)
        v -= rate * grad
        v = np.sign(v) * np.maximum(0, np.abs(v) - rate * l1)
        dt = np.zeros(grades - 1)
        np.add.at(dt, np.minimum(grade, grades - 2), np.where(grade < grades - 1, -a / n, 0))
        np.add.at(dt, np.maximum(grade - 1, 0), np.where(grade > 0, b / n, 0))
        draw = np.concatenate([[dt.sum()], np.array([dt[k + 1 :].sum() * steps[k] for k in range(len(steps))])])
        t2 += draw * draw
        raw -= 0.3 / np.sqrt(t2) * draw
    w[used] = v
    return Ordinal(w.astype(np.float32), raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))]))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: toxic. 1: poor. 2: good. Null where nothing is rated."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality >= 1, 2)


def train(df: DataFrame, ratings: DataFrame, most: int = 8192, most_bytes: int = 64 << 20, grades: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """A model from ``ratings(doc_id, grade)``: at most ``most`` rated documents, those whose ids hash lowest, and of
    those as many, in the same order, as have ``most_bytes`` of features (four bytes each) together.

    Ratings with a null id or grade are passed over, of several ratings of an id the lowest holds. Rows that repeat an
    id are one document, the one whose features sort first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, at in blocks(batches):
            doc, feature = features(buf, at)
            cut = np.searchsorted(doc, np.arange(len(at)))
            packed = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(packed, pa.binary())], ["h", "grade", "features"])

    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = rated.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).orderBy("h", "doc_id").limit(most)
    ids = chosen.select(F.col("doc_id").alias("rated_id"), "grade", "h")
    docs = text_frame(df, id_col, text_col).join(F.broadcast(ids), F.col("doc_id") == F.col("rated_id")).select("h", "text", "grade")
    each_id = docs.mapInArrow(run, "h long, grade int, features binary").groupBy("h", "grade").agg(F.min("features").alias("features"))
    # At most ``most`` rows meet here.
    so_far = F.sum(F.length("features")).over(W.orderBy("h", "features").rowsBetween(W.unboundedPreceding, 0))
    rows = each_id.withColumn("bytes", so_far).where(F.col("bytes") <= most_bytes).select("grade", "features").toArrow()
    each = [np.frombuffer(x, "<i4") for x in rows["features"].to_pylist()]
    doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
    order = sorted(range(len(each)), key=lambda k: (rows["grade"][k].as_py(), each[k].tobytes()))  # the same sum in the same order on each run
    rank = np.empty(len(each), np.int64)
    rank[order] = np.arange(len(each))
    feature = np.concatenate(each) if each else np.zeros(0, np.int32)
    by = np.argsort(rank[doc], kind="stable") if len(doc) else doc
    grade = np.array(rows["grade"].to_pylist(), np.int64)
    return fit(rank[doc][by] if len(doc) else doc, feature[by] if len(doc) else feature, grade[order] if len(each) else grade, grades)


def _scored(model: Ordinal, cut: float, text: int):
    def columns(batch: pa.RecordBatch, buf: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        n = len(at) - 1
        if not len(model.thresholds):
            return [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(np.ones(n, bool))]
        doc, feature = features(buf, at)
        above = model.above(model.score(doc, feature, n))
        above[np.bincount(words(buf, at)[2], minlength=n) == 0] = 0.0
        return [pa.array(above.sum(1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= cut)]

    return columns


def score(df: DataFrame, model: Ordinal, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, p_top, keep, a row for each row of ``df``.

    keep: the top grade's probability is at least ``cut``. Texts without a word (null, empty, blank) have grade 0. If
    the ratings had fewer than two grades, nothing was learnt: grade and probability are null and all rows are kept.
    """
    columns = _scored(model, cut, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, at in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns(batch, buf, at)], ["doc_id", "expected_grade", "p_top", "keep"])

    return text_frame(df, id_col, text_col).mapInArrow(run, "doc_id long, expected_grade double, p_top double, keep boolean")


def select(df: DataFrame, model: Ordinal, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`score` keeps, all their columns, in one pass."""
    columns = _scored(model, cut, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, at in blocks(batches, text_col):
            yield batch.filter(columns(batch, buf, at)[2])

    return df.mapInArrow(run, df.schema)
