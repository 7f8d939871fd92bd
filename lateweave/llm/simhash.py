"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints within ``distance`` 4 agree up to one bit in at least one of three segments (four differing
bits over three segments leave one segment with at most one). Each distinct fingerprint is therefore indexed under
every segment with one bit taken out (64 variants), an equality join on a variant brings the candidates together, and
each candidate is verified on all 64 bits. Equal fingerprints are folded before that, so copies cost nothing; a bucket
yields a spanning forest of its links and never all its pairs. Components come from rounds of large and small stars.

Null and empty texts, and texts of blanks only, have fingerprint zero. A null doc_id takes part, but is a component's
id only if the component has no other. Repeated rows give repeated result rows. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, U64, blocks, cut, partitions, text_frame, words

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # lowest bit, width
#: Buckets up to this size are compared by shifts over the sorted table, larger ones one pivot at a time.
SMALL = 8
_LANES = U64(0x0101010101010101)


def majority(h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each group heads[k] to heads[k + 1] of hashes, no group being empty: bits set in over half.

    Eight counters of a byte are added up in one 64-bit word, for up to 255 hashes at a time.
    """
    size = np.diff(heads)
    per = -(-size // 255)
    group = np.concatenate([[0], np.cumsum(per)])
    start = np.repeat(heads[:-1] - 255 * group[:-1], per) + 255 * np.arange(group[-1])
    on = np.empty((len(size), 64), bool)
    for b in range(8):
        count = np.add.reduceat((h >> U64(b)) & _LANES, start).astype("<u8").view(np.uint8).reshape(-1, 8)
        if len(count) != len(size):
            count = np.add.reduceat(count, group[:-1], axis=0, dtype=np.int64)
        on[:, b::8] = 2 * count.astype(np.int64) > size[:, None]
    return np.packbits(on, axis=1, bitorder="little").view("<u8")[:, 0].astype(U64)


def fingerprints_of(buf: np.ndarray, at: np.ndarray, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The SimHash of each text of a block, as unsigned 64-bit integers."""
    out = np.zeros(len(at) - 1, U64)
    start, end, doc = words(buf, at)
    if not len(start):
        return out
    # One blank after each word, whatever stood there.
    length = end - start
    to = np.concatenate([[0], np.cumsum(length + 1)])
    flat = np.full(int(to[-1]), 0x20, np.uint8)
    inner = np.ones(int(to[-1]), bool)
    inner[to[1:] - 1] = False
    solid = np.zeros(len(buf) + 1, np.int8)
    np.add.at(solid, start, 1)
    np.add.at(solid, end, -1)
    flat[inner] = LOWER[buf[np.cumsum(solid[:-1], dtype=np.int8).astype(bool)]]
    # A document of n words has max(1, n - shingle + 1) shingles.
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.append(first, len(doc)))
    shingles = np.maximum(1, count - shingle + 1)
    rows = np.concatenate([[0], np.cumsum(shingles)])
    head = np.repeat(first - rows[:-1], shingles) + np.arange(rows[-1])
    tail = np.minimum(head + shingle, np.repeat(first + count, shingles)) - 1
    data, digest = flat.tobytes(), xxhash.xxh64_intdigest
    ends = to[tail] + length[tail]
    h = np.fromiter((digest(data[s:e], seed) for s, e in zip(to[head].tolist(), ends.tolist(), strict=True)), U64, len(head))
    out[doc[first]] = majority(h, rows)
    return out


def with_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits in a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, at in blocks(batches):
            fp = fingerprints_of(buf, at, shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return text_frame(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def variants(fp: np.ndarray) -> np.ndarray:
    """[n, 64] keys: the number of the bit taken out (0 to 63) above what is left of its segment."""
    keys = np.empty((len(fp), 64), np.int64)
    for low, width in SEGMENTS:
        part = (fp >> U64(low)) & U64((1 << width) - 1)
        for j in range(width):
            below = part & U64((1 << j) - 1)
            keys[:, low + j] = (((part >> U64(j + 1)) << U64(j)) | below | U64((low + j) << 24)).view(np.int64)
    return keys


def forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within ``distance``, one for each value but the first of a component: a frontier
    takes its neighbours out of the values not yet reached."""
    left, a, b = values, [], []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            pivot = frontier.pop()
            near = np.bitwise_count(left ^ pivot) <= distance
            if near.any():
                found = left[near]
                a.append(np.full(len(found), pivot, U64))
                b.append(found)
                frontier.extend(found)
                left = left[~near]
    none = [np.zeros(0, U64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """src < dst: links among the distinct fingerprints ``fps(fp)`` with the same components as all links have."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 4096):
                part = fp[k : k + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(variants(part.view(U64)).ravel()), pa.array(np.repeat(part, 64))], ["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in whole_keys(batches):
            fp = fp.view(U64)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(first, len(key)))
            a, b = [], []
            rest = np.flatnonzero(np.repeat((count > 1) & (count <= SMALL), count))
            for shift in range(1, SMALL):
                rest = rest[rest + shift < len(key)]
                rest = rest[key[rest] == key[rest + shift]]
                hit = rest[np.bitwise_count(fp[rest] ^ fp[rest + shift]) <= distance]
                a.append(fp[hit])
                b.append(fp[hit + shift])
            for f, n in zip(first[count > SMALL], count[count > SMALL], strict=True):
                x, y = forest(fp[f : f + n], distance)
                a.append(x)
                b.append(y)
            x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            if len(x):
                pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["src", "dst"])

    n = partitions(fps.sparkSession)
    keyed = fps.select("fp").mapInArrow(index, "key long, fp long").repartition(n, "key").sortWithinPartitions("key")
    return keyed.mapInArrow(verify, "src long, dst long").distinct()


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by the first one, in pieces that don't cut a key; what is held is a batch
    and the rows of one key."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        key = columns[0]
        if held and held[0][0][0] != key[0]:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            held.append([c[:last] for c in columns])
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        held.append([c[last:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of edges(src, dst).

    Large-star and small-star rounds; a star's centre is an aggregate, so a node with very many links is combined
    before the shuffle. Each round is kept in the shared folder.
    """
    now = cut(edges.where("src <> dst").distinct())
    if now.isEmpty():
        return now.selectExpr("src node", "dst root")
    while True:
        both = now.union(now.select("dst", "src")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = cut(small.select(F.col("e.v").alias("src"), F.col("e.u").alias("dst")).where("src <> dst").distinct())
        sums = [x.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first() for x in (now, after)]
        now = after
        if sums[0] == sums[1]:
            break
    return now.select(F.col("dst").alias("node"), F.col("src").alias("root")).union(now.select("src", "src").distinct())


def _grouped(df: DataFrame, id_col: str, text_col: str, distance: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, node (fingerprint) of every row; node, root, component_id of every fingerprint."""
    if not 0 <= distance <= 4:
        raise ValueError("three segments with one wildcard each find distances up to 4; see resemblance for more")
    docs = cut(with_fingerprints(df, id_col, text_col).withColumnRenamed("fp", "node"))
    nodes = docs.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    found = components(links(nodes.select(F.col("node").alias("fp")), distance))
    rooted = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Kept, so that its join is one of two exchanges, whose large components Spark can split.
    lowest = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return docs, rooted.join(lowest, "root").select("node", "root", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links, its own included), a row for each row."""
    docs, roots = _grouped(df, id_col, text_col, distance)
    return docs.join(roots.select("node", "component_id"), "node", "left").select("doc_id", F.col("node").alias("fp"), "component_id")


def keep_rows(df: DataFrame, docs: DataFrame, roots: DataFrame, nodes_of: Callable[[np.ndarray, np.ndarray], np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """One row of ``df`` for each root: of the rows with the component's id, the first by node and text.

    docs(doc_id, node) has a row for each of ``df`` and roots(node, root, component_id) for each node. Where every id
    is there once, a semi-join by id does it; else the node of each row that may stay (``nodes_of`` of bytes and
    starts) tells which group it is of, and a limit of one row a group acts in each task before the shuffle.
    """
    own = F.col(f"`{id_col}`").cast("long")
    ids = roots.select(F.col("component_id").alias("__kept_id")).distinct()
    may = df.join(ids, own.eqNullSafe(F.col("__kept_id")), "left_semi")
    if docs.where("doc_id is null").isEmpty() and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return may

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, at in blocks(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes_of(buf, at))], [*batch.schema.names, "__node"])

    noded = may.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("__node", T.LongType())]))
    of = roots.select(F.col("node").alias("__n"), F.col("root").alias("__root"), F.col("component_id").alias("__id"))
    placed = noded.join(of, (F.col("__node") == F.col("__n")) & own.eqNullSafe(F.col("__id")))
    order = W.partitionBy("__root").orderBy("__node", F.xxhash64(F.col(f"`{text_col}`")))
    one = placed.withColumn("__place", F.row_number().over(order)).where("__place = 1")
    return one.select(*(F.col(f"`{c}`") for c in df.columns))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4) -> DataFrame:
    """One row of ``df``, all its columns, for each group: that of the smallest doc_id (a null one only if the group
    has no other). Of rows that repeat that id within the group, one stays."""
    docs, roots = _grouped(df, id_col, text_col, distance)
    return keep_rows(df, docs, roots, lambda buf, at: fingerprints_of(buf, at).view(np.int64), id_col, text_col)
