"""Texts to bags of token vectors: a deterministic encoder of plain expressions, and one that runs a given model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Up to so many values a vector is spelled out, value by value, which Spark compiles. Longer ones are made by functions over
#: arrays: 64 values spelled out were far slower, as the JVM is likely to leave a method that long uncompiled.
SPELLED_OUT = 16


def hash_tokens(texts: DataFrame, dimension: int = 64, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tok, vec: a unit vector for each blank-separated word (lower case), from hashes of the word alone.

    No model is needed and equal words have equal vectors, so bags that share words are alike. A null text is empty and
    an empty text has no token.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), "")
    t = texts.select(F.col(id_col).alias(id_col), F.posexplode(words).alias("tok", "word"))
    value = lambda k: F.pmod(F.xxhash64(F.lit(seed), k, F.col("word")), F.lit(2001)) / 1000.0 - 1.0
    tok = F.col("tok").cast("long").alias("tok")
    if dimension <= SPELLED_OUT:
        raw = [F.col(f"__raw{k}") for k in range(dimension)]
        t = t.select(id_col, tok, *(value(F.lit(k)).alias(f"__raw{k}") for k in range(dimension)))
        t = t.withColumn("size", F.sqrt(reduce(add, (x * x for x in raw), F.lit(0.0))))
        return t.select(id_col, "tok", F.when(F.col("size") > 0, F.array(*(x / F.col("size") for x in raw))).otherwise(F.array(*raw)).alias("vec"))
    t = t.select(id_col, tok, F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), value).alias("raw"))
    size = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    return t.withColumn("size", size).select(id_col, "tok", F.transform("raw", lambda x: F.when(F.col("size") > 0, x / F.col("size")).otherwise(x)).alias("vec"))


def model_tokens(texts: DataFrame, load: Callable[[], Callable[[list[str]], list[np.ndarray]]], id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, batch: int = 64) -> DataFrame:
    """id, tok, vec by a model: ``load()`` runs once in each task and gives a function from texts to [tokens, dimension]
    arrays. A title is put before its text. Arrays of another shape, or values that aren't numbers, are an error."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if title_col:
        text = F.trim(F.concat_ws(" ", F.col(title_col), text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                bags = [as_matrix(x) for x in encode(part.column(1).to_pylist())]
                size = np.array([len(x) for x in bags])
                if not size.sum():
                    continue
                vecs = np.concatenate([x for x in bags if len(x)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vecs) + 1) * vecs.shape[1], pa.int32()), pa.array(vecs.ravel()))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(bags)), size)))
                toks = np.concatenate([np.arange(n) for n in size])
                yield pa.RecordBatch.from_arrays([ids, pa.array(toks, pa.int64()), lists], [id_col, "tok", "vec"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, text.alias("text")).mapInArrow(run, f"`{id_col}` {kind}, tok long, vec array<double>")


def as_matrix(x: object) -> np.ndarray:
    """Anything that holds rows of numbers (arrays, nested lists, tensors that convert) as [tokens, dimension] doubles."""
    for step in ("detach", "cpu", "numpy"):
        if not isinstance(x, np.ndarray) and hasattr(x, step):
            x = getattr(x, step)()
    if not isinstance(x, np.ndarray | list | tuple):
        raise TypeError(f"not an array: {type(x).__name__}")
    out = np.asarray(x, np.float64)
    if out.size == 0:
        return out.reshape(0, 0)
    if out.ndim != 2:
        raise ValueError(f"a bag has two dimensions, not {out.ndim}")
    return out
