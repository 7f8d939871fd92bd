"""What the operators of this folder share: table access, the shared folder, and text work on Arrow buffers.

Texts are handled as one NumPy byte buffer for a block of documents; a block holds about ``BLOCK`` bytes (or one
longer document), so memory follows the longest document and not the partition.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 2 << 20
#: Bytes of text on which work goes byte by byte at a time, so that its arrays stay in a core's cache.
TILE = 1 << 17
U64 = np.uint64
#: The six ASCII blanks of the word pattern ``[^\x20\x09-\x0D]+``.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where none is set a local master, whose executors are
    this machine, gets a temporary one, which goes with the process; any other is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="lateweave-")
            atexit.register(shutil.rmtree, top, ignore_errors=True)
        sc.setCheckpointDir(top)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder, where the loss of an executor can't touch it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """A text column without nulls, with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def raw(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each starts (one entry more than texts)."""
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``most`` bytes of text each, with those bytes and the texts' starts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = strings(batch.column(batch.schema.get_field_index(text)))
        buf, at = raw(texts)
        row = 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
            yield batch.slice(row, end - row), buf[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end


def tiles(at: np.ndarray, most: int = TILE) -> Iterator[tuple[int, int]]:
    """First text and end of each stretch of a block's texts that has about ``most`` bytes (or one longer text)."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, b
        a = b


def runs(solid: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of true values; no run crosses a document's end."""
    if not len(solid):
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before[at[:-1][at[:-1] < len(solid)]] = False
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The :func:`runs` of non-blank bytes."""
    return runs(~BLANK[buf], at)


_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        _powers[:] = [np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64), dtype=U64)]) for b in (_BASE, _INVERSE)]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """Sums from which :func:`span_hashes` takes the hash of any span."""
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum(_TABLE[buf] * _power(len(buf) + 1)[0][: len(buf)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span that depends on nothing but those bytes."""
    return mix((sums[end] - sums[start]) * _power(len(sums))[1][start])


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """:func:`span_hashes` of all spans of ``width`` bytes."""
    return mix((sums[width:] - sums[:-width]) * _power(len(sums))[1][: len(sums) - width])


def text_frame(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns that an operator works with, under names of its own; no other column can clash."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`") for c in more))


def range_of(value: Column, splits: list[int]) -> Column:
    """How many of the ascending ``splits`` are below ``value``: first whole stretches of them, then within one, so a
    row costs about twice the root of their number."""
    if not splits:
        return F.lit(0)
    step = math.isqrt(len(splits))
    array = lambda some: F.expr(f"array({','.join(f'{x}L' if x >= 0 else f'({x + 1}L - 1L)' for x in some)})")
    below = lambda some: F.size(F.filter(some, lambda s: s < value))
    whole = below(array(splits[step - 1 :: step])) * step
    return whole + below(F.slice(array(splits), whole + 1, F.lit(step)))
