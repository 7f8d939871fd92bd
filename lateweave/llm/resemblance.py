"""SimHash near-duplicates by the resemblance of shingle sets: 0.8 or more of the five-word shingles of both texts.

The steps are those of :mod:`simhash`, with a longer fingerprint: segments, one-bit deletion variants, an equality join
on variants, verification, star contraction. At a resemblance of 0.8 a bit of two fingerprints differs with a
probability of about 0.15, so of a segment of 16 bits at most one differs in 0.28 of all pairs, and by calculation one
of the 24 segments finds a pair of resemblance 0.8 with probability 0.9996, of 0.9 with more than 0.9999999. (Of sets of
four and five shingles 0.19 of the bits differ, which is the worst there is: 0.988.)

Each segment with one bit taken out is a variant (16 for a segment, 384 for a fingerprint). All variants whose bit is
out of the one byte of a segment agree on its other byte, so a fingerprint is dealt out once a byte and its variants are
made and joined where it arrives: 48 rows travel for 384 variants. What meets at a variant and is near on all 384 bits
is connected. Sets that are connected, directly or over others, make a group.

Equal sets are folded before anything is compared. Of a group, every member is verified on the shingle sets against the
least one it met. Of groups that this doesn't connect, the members outside the largest connected class are compared
exactly with the group, block by block (:func:`meetings`); what comes out are the links that connect classes and never
all pairs.

Case and blanks don't count; a text of fewer than five words is one shingle, and texts without a word are one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, blocks, cut, mix, partitions, prefix_hashes, span_hashes, text_frame, tiles, words
from .simhash import components, keep_rows, majority, whole_keys

WORDS, WORDS_OF_BITS = 5, 6
#: A segment is two bytes of the fingerprint.
BYTES = 8 * WORDS_OF_BITS
#: Bits of all 384 that candidates may differ in (at 0.8 about 58 do, with a deviation of 7), and of the first 64.
FAR, FAR_FIRST = 92, 26
#: Sets wanted for verification up to which only the texts that have them are read again, by a broadcast of their ids.
FEW = 1 << 20
#: Bytes of shingle sets in a block of a group whose members are compared with one another.
MEETING = 1 << 18
_STEP = U64(0xD6E8FEB86659FD93)
_SALTS = np.random.default_rng(7).integers(0, 1 << 63, WORDS_OF_BITS, dtype=np.int64).astype(U64)


def grams(buf: np.ndarray, at: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every distinct shingle of a block's texts, in order of both."""
    found = []
    for a, b in tiles(at):
        owner, h = _grams(buf[at[a] : at[b]], at[a : b + 1] - at[a], n)
        found.append((owner + a, h))
    none = (np.zeros(0, np.int64), np.zeros(0, U64))
    owner, h = (np.concatenate(c) for c in zip(none, *found, strict=True))
    return owner, h


def _grams(buf: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    start, end, doc = words(buf, at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    word = span_hashes(prefix_hashes(LOWER[buf]), start, end)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.append(first, len(doc)))
    shingles = np.maximum(1, count - n + 1)
    rows = np.concatenate([[0], np.cumsum(shingles)])
    head = np.repeat(first - rows[:-1], shingles) + np.arange(rows[-1])
    each, beyond = np.zeros(len(word), U64), np.concatenate([word, np.zeros(n, U64)])
    for k in range(n):
        each = each * _STEP + beyond[k : k + len(word)]
    h = each[head]
    for k in np.flatnonzero(count < n).tolist():  # all words of a short text are its shingle
        one = U64(0)
        with np.errstate(over="ignore"):
            for x in word[first[k] : first[k] + count[k]]:
                one = one * _STEP + x
        h[rows[k]] = one
    h, owner = mix(h), np.repeat(doc[first], shingles)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    return owner[new], h[new]


def sets_of(buf: np.ndarray, at: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each text's set (0: no word), the texts that have one, where it starts (one entry more), and hashes."""
    owner, h = grams(buf, at, n)
    node = np.zeros(len(at) - 1, U64)
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(h) else np.zeros(0, np.int64)
    if len(h):
        node[owner[heads]] = mix(np.add.reduceat(mix(h ^ _STEP), heads))
    return node.view(np.int64), owner[heads], np.append(heads, len(h)), h


def signatures(h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """[sets, WORDS_OF_BITS]: the fingerprint of each set."""
    return np.stack([majority(mix(h ^ salt), heads) for salt in _SALTS], 1)


def distance(fp: np.ndarray, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Bits in which rows a and b of the fingerprints differ."""
    return np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64)


def variants(other: np.ndarray, place: np.ndarray) -> np.ndarray:
    """[8, n] keys: where a fingerprint was dealt to, which bit of the segment's other byte is out, and what is left."""
    other = other.astype(np.int64)
    return np.stack([place << 10 | j << 7 | (other >> (j + 1)) << j | other & ((1 << j) - 1) for j in range(8)])


def near(key: np.ndarray, fp: np.ndarray, large: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect what shares a variant and differs in ``FAR`` bits or fewer.

    The rows of a key (a byte of the fingerprint: its number and value) agree on that byte. Variants of up to ``large``
    rows are compared by shifts over the sorted table, larger ones one pivot at a time, which yields a forest."""
    n = len(key)
    other = np.ascontiguousarray(fp).astype("<u8").view(np.uint8)[np.arange(n), (key >> 8) ^ 1]
    code = variants(other, np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))).ravel()
    # Sorted with the number of the variant below, which numpy does faster than an argsort; 2^25 rows of a key fit.
    code = np.sort(code << 28 | np.arange(len(code)))
    order = code & ((1 << 28) - 1)
    row = order % n
    edges = np.flatnonzero(np.concatenate([[True], code[1:] >> 28 != code[:-1] >> 28]))
    count = np.diff(np.append(edges, len(code)))
    # A pair that agrees in the whole segment meets at all its variants; it counts at the first of them.
    whole = (order < n) & ((key[row] >> 8) % 2 == 0)
    a, b, first, own = [], [], np.ascontiguousarray(fp[:, 0])[row], other[row]
    after = (np.repeat(edges + count, count) - np.arange(1, len(code) + 1)).astype(np.int32)
    after[np.repeat(count > large, count)] = 0
    rest = None
    for shift in range(1, int(after.max(initial=0)) + 1):
        if rest is None:
            inside = after[:-shift] >= shift
            hit = np.flatnonzero(inside & (np.bitwise_count(first[shift:] ^ first[:-shift]) <= FAR_FIRST))
            rest = np.flatnonzero(inside) if 4 * np.count_nonzero(inside) < len(code) else None
        else:
            rest = rest[after[rest] >= shift]
            hit = rest[np.bitwise_count(first[rest + shift] ^ first[rest]) <= FAR_FIRST]
        hit = hit[whole[hit] | (own[hit] != own[hit + shift])]
        x, y = row[hit], row[hit + shift]
        hit = distance(fp, x, y) <= FAR
        a.append(x[hit])
        b.append(y[hit])
    for f, m in zip(edges[count > large].tolist(), count[count > large].tolist(), strict=True):
        left = row[f : f + m]
        while len(left) > 1:
            frontier, left = [left[0]], left[1:]
            while frontier and len(left):
                pivot = frontier.pop()
                hit = distance(fp, left, pivot) <= FAR
                found, left = left[hit], left[~hit]
                a.append(np.full(len(found), pivot))
                b.append(found)
                frontier.extend(found.tolist())
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """least, node: every node of the links a, b that isn't the least one of those it is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(x) and (label[x] != label[y]).any():
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def with_signatures(df: DataFrame, shingle: int = WORDS) -> DataFrame:
    """doc_id, node, signature (null without a word) of every row of df(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, at in blocks(batches):
            node, has, heads, h = sets_of(buf, at, shingle)
            rows: list[bytes | None] = [None] * len(node)
            if len(has):
                for k, x in zip(has.tolist(), signatures(h, heads).astype("<u8"), strict=True):
                    rows[k] = x.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(node), pa.array(rows, pa.binary())], ["doc_id", "node", "signature"])

    return df.mapInArrow(run, "doc_id long, node long, signature binary")


def with_sets(df: DataFrame, shingle: int = WORDS) -> DataFrame:
    """node, grams (32 bits of each shingle's hash) of every set among df(doc_id, text) that has a word, once a task: so
    a task sends one row of a set however many copies of it there are (it remembers eight bytes a set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.int64)
        for _, buf, at in blocks(batches):
            node, has, heads, h = sets_of(buf, at, shingle)
            short = (h >> U64(32)).astype("<u4")
            some, first = np.unique(node[has], return_index=True)
            first = first[~np.isin(some, known, assume_unique=True)]
            known = np.union1d(known, some)
            sets = [short[heads[k] : heads[k + 1]].tobytes() for k in first.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(node[has[first]]), pa.array(sets, pa.binary())], ["node", "grams"])

    return df.mapInArrow(run, "node long, grams binary")


def resemblance(a: bytes, b: bytes) -> float:
    x, y = (np.unique(np.frombuffer(s, "<u4")) for s in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def forest(nodes: list[int], sets: list[bytes], share: float, roots: list[int] | None = None, pivots: int | None = None) -> list[tuple[int, int]]:
    """Links of ``share`` or more that connect the sets, directly or over others. The first ``pivots`` sets meet the
    others (None: all meet all); sets with the same root count as connected."""
    each = [np.unique(np.frombuffer(s, "<u4")) for s in sets]
    group = np.array(nodes if roots is None else roots, np.int64)
    first, of = (len(each), 0) if pivots is None else (pivots, pivots)
    if not first or of == len(each):
        return []
    size = np.array([len(x) for x in each])
    at = np.concatenate([[0], np.cumsum(size)])
    values, place = np.unique(np.concatenate(each), return_inverse=True)
    targets, heads = place[at[of] :], at[of:-1] - at[of]
    mark, out = np.zeros(len(values), np.int32), []
    for p in range(first):
        if (group[of:] == group[p]).all():
            continue
        own = place[at[p] : at[p + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[targets], heads)
        mark[own] = 0
        found = of + np.flatnonzero((group[of:] != group[p]) & (both >= share * (size[p] + size[of:] - both) - 1e-9))
        joined, some = np.unique(group[found], return_index=True)
        out += [(min(nodes[p], nodes[k]), max(nodes[p], nodes[k])) for k in found[some].tolist()]
        group[np.isin(group, joined)] = group[p]
    return out


def candidates(nodes: DataFrame) -> DataFrame:
    """src < dst: links among nodes(node, signature) that connect what shares a variant and has a near fingerprint."""
    columns = ["key", "node", *(f"w{k}" for k in range(WORDS_OF_BITS))]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                fp = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i8").reshape(-1, WORDS_OF_BITS)
                keys = np.arange(BYTES, dtype=np.int32)[:, None] << 8 | fp.view(np.uint8).T
                dealt = [keys.ravel(), *(np.tile(x, BYTES) for x in (part.column(0).to_numpy(), *fp.T))]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, dealt)), columns)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, *fp in whole_keys(batches):
            a, b = near(key, np.stack(fp, 1).view(U64), large)
            if len(a):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, stars(node[a], node[b]))), ["src", "dst"])

    coded = nodes.where("signature is not null").select("node", "signature")
    # Four times as many as unrelated fingerprints would be at a variant, by chance.
    large = 64 + 4 * (coded.count() >> 15)
    rows = coded.mapInArrow(index, f"key int, node long, {', '.join(f'{c} long' for c in columns[2:])}")
    rows = rows.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key")
    return cut(rows.mapInArrow(met, "src long, dst long").distinct())


def links(docs: DataFrame, nodes: DataFrame, share: float = 0.8, shingle: int = WORDS) -> DataFrame:
    """src < dst: links among nodes(node, first_id, signature) of docs(doc_id, text), with the components of all verified
    candidates."""
    spark = docs.sparkSession
    n = partitions(spark)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [resemblance(a, b) >= share - 1e-12 for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            pair = forest(ids, sets, share, roots, None if one else len(ids) - sum(other))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pair], pa.int64()), pa.array([b for _, b in pair], pa.int64())], ["src", "dst"])

        meeting, one = None, False
        ids, roots, sets, other = [], [], [], []
        for batch in batches:
            for g, a, b, side, node, root, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, a, b) != meeting and ids:
                    yield out()
                    ids, roots, sets, other = [], [], [], []
                meeting, one = (g, a, b), a == b
                for held, x in zip((ids, roots, sets, other), (node, root, s, side), strict=True):
                    held.append(x)
        if ids:
            yield out()

    met = candidates(nodes)
    if met.isEmpty():
        return spark.createDataFrame([], "src long, dst long")
    groups = cut(components(met).withColumnRenamed("root", "grp"))
    wanted = groups.select("node")
    ids = nodes.join(wanted, "node", "left_semi").select(F.col("first_id").alias("wanted_id")).distinct()
    if groups.count() <= FEW:
        docs = docs.join(F.broadcast(ids), F.col("doc_id").cast("long").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = cut(with_sets(docs, shingle).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams")))
    of = lambda name, grams: sets.select(F.col("node").alias(name), F.col("grams").alias(grams))
    least = cut(met.groupBy("dst").agg(F.min("src").alias("src")))
    pairs = least.join(of("dst", "b"), "dst").join(of("src", "a"), "src").select("src", "dst", "a", "b")
    sure = cut(pairs.mapInArrow(verify, "src long, dst long"))
    roots = cut(components(sure))
    placed = groups.join(roots, "node", "left").select("grp", "node", F.coalesce("root", "node").alias("root"))
    apart = cut(placed.groupBy("grp").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("grp"))
    if apart.isEmpty():
        return sure
    rest = cut(placed.join(apart, "grp").join(sets, "node").select("grp", "node", "root", "grams"))
    compared = meetings(rest).repartition(n, "grp", "a", "b").sortWithinPartitions("grp", "a", "b", "side")
    return sure.union(compared.mapInArrow(connect, "src long, dst long")).distinct()


def meetings(members: DataFrame, block: int = MEETING) -> DataFrame:
    """grp, a, b, side, node, root, grams: which of members(grp, node, root, grams) are compared where.

    A group's largest class of one root is connected already; the rest of the group meets itself and that class. Both
    are dealt into blocks of about ``block`` bytes, the rest's first, and blocks a and b meet as rows of (grp, a, b),
    with those of a on side 0. So what one task holds is two blocks, whatever the size of the group.
    """
    weight = F.sum(F.length("grams") + 64)
    classes = members.groupBy("grp", "root").agg(F.count("*").alias("n"), weight.alias("size"))
    largest = F.max(F.struct("n", "root", "size"))
    dealt_into = lambda n, size: F.least(n, F.ceil(size / block))
    # Kept, so that its join is one of two exchanges, whose large groups Spark can split.
    plan = cut(
        classes.groupBy("grp")
        .agg(F.sum("size").alias("size"), F.sum("n").alias("n"), largest.alias("m"))
        .select("grp", F.col("m.root").alias("main"), dealt_into(F.col("n") - F.col("m.n"), F.col("size") - F.col("m.size")).alias("few"), dealt_into(F.col("m.n"), F.col("m.size")).alias("many"))
    )
    dealt = lambda blocks: F.pmod(F.xxhash64("node", F.lit(11)), blocks)
    placed = members.join(plan, "grp").withColumn("own", F.when(F.col("root") == F.col("main"), F.col("few") + dealt(F.col("many"))).otherwise(dealt(F.col("few"))))
    others = F.when(F.col("own") < F.col("few"), F.sequence(F.lit(0).cast("long"), F.col("few") + F.col("many") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("few") - 1))
    rows = placed.select("grp", "node", "root", "grams", "own", F.explode(others).alias("other"))
    return rows.select("grp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "root", "grams")


def _grouped(df: DataFrame, id_col: str, text_col: str, share: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, node of every row; node, root, component_id of every set."""
    texts = text_frame(df, id_col, text_col)
    docs = cut(with_signatures(texts, shingle))
    nodes = cut(docs.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature")))
    found = components(links(texts, nodes, share, shingle))
    rooted = cut(nodes.select("node", "first_id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # Kept, so that its join is one of two exchanges, whose large components Spark can split.
    lowest = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return docs.select("doc_id", "node"), rooted.join(lowest, "root").select("node", "root", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.8, shingle: int = WORDS) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over links, its own included), a row for each row.

    Null texts are empty. A null doc_id takes part, but is a component's id only if the component has no other.
    """
    docs, roots = _grouped(df, id_col, text_col, share, shingle)
    return docs.join(roots.select("node", "component_id"), "node", "left").select("doc_id", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.8, shingle: int = WORDS) -> DataFrame:
    """One row of ``df``, all its columns, for each group: that of the smallest doc_id (a null one only if the group
    has no other). Of rows that repeat that id within the group, one stays."""

    def nodes_of(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sets_of(buf, at, shingle)[0]

    return keep_rows(df, *_grouped(df, id_col, text_col, share, shingle), nodes_of, id_col, text_col)
