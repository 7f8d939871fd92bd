"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``linear * n + quadratic * n^2`` (attention stays within a piece). Whole sequences are cut
off documents longer than one; what remains of each, in descending order, goes to the sequence of least cost among all
open ones that have room for the whole of it. Nearly as many as the tokens need are open from the start, which spreads
the cost; a piece for which none has room opens a new one. So a document that fits a sequence is never cut.

Documents are packed where they are read: a block of a partition fills its own sequences, nothing is shuffled, and a
lost task repeats the same blocks. Cost is balanced within a block.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import blocks, text_frame
from .tokens import encoder

#: Bytes of text packed together.
BLOCK = 8 << 20
#: Sequences open from the start, as a share of the least number that the tokens could fill. More balance costs better,
#: but leave gaps too small for what comes last.
AHEAD = 0.95
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(lengths: list[int], room: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences count from 0."""
    pieces, tails, sequence = [], [], 0
    for d, n in enumerate(lengths):
        for k in range(n // room):
            pieces.append((d, k * room, room, sequence, 0))
            sequence += 1
        if n % room:
            tails.append((n % room, d))
    tails.sort(key=lambda x: (-x[0], x[1]))
    # Open sequences by the room they have left, the cheapest first, and the least cost for each amount of room.
    open_: list[list[tuple[float, int]]] = [[] for _ in range(room + 1)]
    least = np.full(room + 1, np.inf)
    if tails:
        ready = math.ceil(AHEAD * -(-sum(n for n, _ in tails) // room))
        open_[room] = [(0.0, sequence + k) for k in range(ready)]
        least[room], sequence = 0.0, sequence + ready
    for n, d in tails:
        left = n + int(least[n:].argmin())
        if open_[left]:
            cost, s = heapq.heappop(open_[left])
            least[left] = open_[left][0][0] if open_[left] else np.inf
        else:  # none has room for it
            cost, s, left, sequence = 0.0, sequence, room, sequence + 1
        pieces.append((d, lengths[d] - n, n, s, room - left))
        if left > n:
            heapq.heappush(open_[left - n], (cost + linear * n + quadratic * n * n, s))
            least[left - n] = open_[left - n][0][0]
    return pieces


def packed(df: DataFrame, tokenizer: str, sequence: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", linear: float = 1.0, quadratic: float = 1 / 1024, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A document is the tokenizer's ids of its whole text (null: empty) and ``end_id``; so an empty text is one token.
    Null ids and repeated rows are packed like others; an empty table gives no piece. sequence_id holds the partition
    in its upper bits. A trainer pads a sequence to ``sequence`` tokens unless its length is a power of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base, seen = encoder(tokenizer), TaskContext.get().partitionId() << 33, 0
        for batch, _, _ in blocks(batches, most=BLOCK):
            ids = [np.append(x, np.uint32(end_id)) for x in enc.ids(batch.column(1).fill_null("").to_pylist())]
            pieces = pack([len(x) for x in ids], sequence, linear, quadratic)
            doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            parts = [np.ascontiguousarray(ids[d][s : s + n], "<u4") for d, s, n, _, _ in pieces]
            crc = np.array([zlib.crc32(x) for x in parts], np.int64)
            total = np.array([len(x) for x in ids], np.int64)[doc]
            columns = [batch.column(0).cast(pa.int64()).take(pa.array(doc)), *map(pa.array, (start, length, crc, total, base + seen + seq, offset))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
            seen += int(seq.max()) + 1

    return text_frame(df, id_col, text_col).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
