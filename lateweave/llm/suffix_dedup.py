"""Removal of repeated substrings by a distributed sort of suffixes.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier goes. All suffixes need not be sorted to
find those: a window of LENGTH bytes is represented by its anchor, the leftmost of its GRAM-byte substrings of least
hash. Equal windows have equal anchors at equal places, so a window can only repeat where its anchor's gram repeats
(one shuffle of hashes finds those, about one for every 39 bytes), and it does repeat where two anchors agree on d
bytes to the left and LENGTH - d to the right, d being the anchor's distance from the window's start. Hence:

1. texts that repeat a whole earlier text are settled by their SHA-256;
2. anchors whose gram occurs once are dropped;
3. what stands right of each other anchor, and (reversed) left of it, goes out as sorted, front-coded runs, dealt by gram;
4. runs are merged by loser trees that keep each head's common prefix with the last output: heads compare by that
   length alone, or from that byte on, and never over bytes known to be equal;
5. the merge's prefix lengths cut both orders into classes; within equal classes the first window stays.

Hashes of grams only select candidates, for which bytes decide; whole texts are equal if their SHA-256 is. Within a run, anchors with the same surroundings
are folded into the first, which bounds what a frequent passage sends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, blocks, cut, mix, partitions, prefix_hashes, range_of, tiles, window_hashes

LENGTH, GRAM = 100, 24
SIDE = LENGTH - GRAM  # the largest distance of an anchor from its window's start
#: Anchors of a task that make a run.
RUN = 1 << 17
NO_ID = (1 << 63) - 1


def anchors(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block of texts: each anchor's document, place in the block, gram hash, and the least and greatest distance
    from the starts of the windows it represents (consecutive ones)."""
    found = [tuple(np.zeros(0, np.int64) for _ in range(5))]
    for a, b in tiles(at):
        if at[b] - at[a] >= LENGTH:
            doc, place, *rest = _anchors(buf[at[a] : at[b]], at[a : b + 1] - at[a])
            found.append((doc + a, place + at[a], *rest))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _anchors(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(buf)
    h = window_hashes(prefix_hashes(buf), GRAM)
    # The hash's upper half and the place: the same choice in a block of any size.
    low = (h >> U64(32) << U64(32)) | np.arange(n - GRAM + 1).astype(U64)
    width = 1
    while 2 * width <= SIDE + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (SIDE + 1 - width)], low[SIDE + 1 - width :])
    place = (low & U64((1 << 32) - 1)).astype(np.int64)  # by window start
    s = np.flatnonzero(np.arange(LENGTH, len(place) + LENGTH) <= np.repeat(at[1:], np.diff(at))[: len(place)])
    p = place[s]
    head = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(s) else s
    tail = np.append(head[1:], len(s)) - 1 if len(s) else s
    p = p[head]
    return np.searchsorted(at, p, "right") - 1, p, h[p].view(np.int64), p - s[tail], p - s[head]


def surroundings(buf: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[anchors, LENGTH] bytes from each anchor on, and [anchors, SIDE] bytes before it, the nearest first; zero beyond
    the text, where no window of the anchor reaches."""
    view = np.lib.stride_tricks.sliding_window_view
    right = view(np.concatenate([buf, np.zeros(LENGTH, np.uint8)]), LENGTH)[place]
    right[np.arange(LENGTH) >= (at[doc + 1] - place)[:, None]] = 0
    left = view(np.concatenate([np.zeros(SIDE, np.uint8), buf]), SIDE)[place][:, ::-1].copy()
    left[np.arange(SIDE) >= (place - at[doc])[:, None]] = 0
    return right, left


def front_code(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The order of the rows, each sorted row's common prefix with the one before, and what follows that prefix."""
    n, width = rows.shape
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}")[:, 0], kind="stable")
    rows = rows[order]
    same = np.zeros(n, np.uint8)
    if n > 1:
        differ = rows[1:] != rows[:-1]
        same[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return order, same, rows[np.arange(width) >= same[:, None]].tobytes()


def strings_of(same: np.ndarray, rest: bytes, width: int) -> list[bytes]:
    out, last, at = [], b"", 0
    for k in same.tolist():
        last = last[:k] + rest[at : at + width - k]
        at += width - k
        out.append(last)
    return out


def merge(runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, place in the run, and common prefix with the string before, of all strings in order.

    A loser tree whose nodes hold runs. known[r] is the common prefix of run r's head with the last string that won
    against it, so of two heads the one with more in common is less; only heads with equal lengths are compared, from
    that byte on. An exhausted run has -1 in common and loses to all.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    known = [0 if r < k and runs[r][0] else -1 for r in range(size)]
    head = [runs[r][0][0] if r < k and runs[r][0] else b"" for r in range(size)]
    nexts = [0] * size
    number = int.from_bytes

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = head[a][x:], head[b][x:]
        if s == t:
            first, last = (a, b) if a < b else (b, a)
            known[last] = width
            return first, last
        common = x + len(s) - ((number(s, "big") ^ number(t, "big")).bit_length() + 7) // 8
        if s < t:
            known[b] = common
            return a, b
        known[a] = common
        return b, a

    losers = [0] * size
    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        up = []
        for j in range(0, len(level), 2):
            w, losers[node + j // 2] = play(level[j], level[j + 1])
            up.append(w)
        level = up
    winner, total = level[0], sum(len(r[0]) for r in runs)
    of, index, common = [0] * total, [0] * total, [0] * total
    for j in range(total):
        r, i = winner, nexts[winner]
        of[j], index[j], common[j] = r, i, known[r]
        i += 1
        nexts[r] = i
        texts, same = runs[r]
        if i < len(texts):
            head[r], known[r] = texts[i], same[i]
        else:
            known[r] = -1
        node = (size + r) >> 1
        w = r
        while node:
            o = losers[node]
            x, y = known[w], known[o]
            if y > x:
                losers[node], w = w, o
            elif x == y and x >= 0:
                w, losers[node] = play(w, o)
            node >>= 1
        winner = w
    return np.array(of), np.array(index), np.array(common)


def repeats(key: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray, right: tuple, left: tuple) -> tuple[np.ndarray, ...]:
    """key, start, end of the bytes that go, from anchors and both merges (rank by anchor, common prefix by rank)."""
    n = len(key)
    first = np.lexsort((place, key))  # earlier anchors first
    key, place, least, most = key[first], place[first], least[first], most[first]
    rank_r, rank_l = right[0][first], left[0][first]
    again = np.zeros((n, SIDE + 2), bool)
    for d in range(SIDE + 1):
        own = np.flatnonzero((least <= d) & (d <= most))
        if not len(own):
            continue
        r = np.cumsum(right[1] < LENGTH - d)[rank_r[own]]
        if d:
            r = np.cumsum(left[1] < d)[rank_l[own]] * (n + 1) + r
        order = np.argsort(r, kind="stable")
        again[own[order[1:]][r[order[1:]] == r[order[:-1]]], d] = True
    edge = np.diff(again.astype(np.int8), axis=1, prepend=0)
    a, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return key[a], place[a] - (high - 1), place[a] - low + LENGTH


def _pack(*parts: np.ndarray | bytes) -> bytes:
    raw = [p if isinstance(p, bytes) else np.ascontiguousarray(p).tobytes() for p in parts]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(p) for p in raw], "<i8").tobytes() + b"".join(raw))


def _unpack(data: bytes, parts: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(np.frombuffer(raw[: 8 * parts], "<i8")) + 8 * parts
    return [raw[a:b] for a, b in zip([8 * parts, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (route, key, at), at being twice the place and 1 more if the gram is sure to repeat, which it is if the
    block holds it several times. Its first anchor then goes where grams are counted, for the sake of other blocks, its
    others each by a route of its own, and so do all anchors of that gram in later blocks of the task. So however
    frequent a gram is, where it is counted there are a few rows of it a task. Routes are 48 bits: where two grams share
    one, both are candidates."""
    known = np.zeros(0, np.int64)  # grams that are sure to repeat, sorted
    for batch, buf, at in blocks(batches):
        doc, place, gram, _, _ = anchors(buf, at)
        key, place = batch.column(0).to_numpy()[doc], place - at[doc]
        order = np.argsort(gram, kind="stable")
        same = gram[order[1:]] == gram[order[:-1]]
        later, sure = np.zeros(len(gram), bool), np.zeros(len(gram), bool)
        later[order[1:][same]] = True
        sure[order[1:][same]] = sure[order[:-1][same]] = True
        before = known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram if len(known) else np.zeros(len(gram), bool)
        known = np.union1d(known, gram[sure & ~before])
        later, sure = later | before, sure | before
        own = mix(mix(key.view(U64) + U64(1)) + place.view(U64)).view(np.int64)
        route = np.where(later, own, gram) & ((1 << 48) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(key), pa.array(2 * place + sure)], ["route", "key", "at"])


def _runs(buckets: int):
    """Rows of (bucket, kind, run): 0 for a run of anchors, 1 for bytes known to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> pa.RecordBatch:
            key, place, gram, least, most = (np.concatenate([h[k] for h in held]) for k in range(5))
            right, left = np.concatenate([h[5] for h in held]), np.concatenate([h[6] for h in held])
            order = np.lexsort((place, key))
            whole = np.concatenate([right, left, least.astype(np.uint8)[:, None], most.astype(np.uint8)[:, None]], 1)[order]
            sort = np.argsort(np.ascontiguousarray(whole).view(f"S{whole.shape[1]}")[:, 0], kind="stable")
            same = np.concatenate([[False], (whole[sort][1:] == whole[sort][:-1]).all(1)])
            fold = np.zeros(len(order), bool)
            fold[sort[same]] = True  # the earliest of equal surroundings stays
            gone, stay = order[fold], np.sort(order[~fold])
            rows = []
            if len(gone):
                rows.append((int(gram[gone[0]] % buckets), 1, _pack(key[gone], place[gone] - most[gone], place[gone] - least[gone] + LENGTH)))
            bucket = gram[stay] % buckets
            by = np.argsort(bucket, kind="stable")
            stay, bucket = stay[by], bucket[by]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(stay)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                mine = stay[a:b]
                o, same_r, rest_r = front_code(right[mine])
                mine = mine[o]  # anchors in the order of what follows them
                o, same_l, rest_l = front_code(left[mine])
                rows.append((int(bucket[a]), 0, _pack(key[mine], place[mine], least[mine].astype(np.uint8), most[mine].astype(np.uint8), same_r, rest_r, o.astype("<i4"), same_l, rest_l)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "run"])

        for batch, buf, at in blocks(batches):
            doc, place, gram, least, most = anchors(buf, at)
            # Of each document's anchors, those whose gram occurs again.
            wanted = batch.column(batch.schema.get_field_index("places"))
            size = wanted.value_lengths().to_numpy()
            named = np.sort((np.repeat(at[:-1], size) + wanted.flatten().to_numpy()))
            keep = np.isin(place, named, assume_unique=False)
            doc, place, gram, least, most = (x[keep] for x in (doc, place, gram, least, most))
            for k in range(0, len(doc), RUN):
                part = slice(k, k + RUN)
                right, left = surroundings(buf, at, doc[part], place[part])
                held.append((batch.column(0).to_numpy()[doc[part]], place[part] - at[doc[part]], gram[part], least[part], most[part], right, left))
                count += len(right)
                if count >= RUN:
                    yield flush()
                    count = 0
        if count:
            yield flush()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "start", "end"]

    def settle(runs: list[bytes]) -> pa.RecordBatch | None:
        kinds = (np.int64, np.int64, np.uint8, np.uint8, np.uint8, None, "<i4", np.uint8, None)
        got = [[p if k is None else np.frombuffer(p, k) for p, k in zip(_unpack(r, 9), kinds, strict=True)] for r in runs]
        base = np.concatenate([[0], np.cumsum([len(g[0]) for g in got])])
        sides = []
        for side in (0, 1):
            width = SIDE if side else LENGTH
            same, rest = (7, 8) if side else (4, 5)
            of, index, common = merge([(strings_of(g[same], g[rest], width), g[same].tolist()) for g in got], width)
            order = [g[6] if side else np.arange(len(g[0])) for g in got]
            rank = np.empty(base[-1], np.int64)
            rank[np.concatenate([o + b for o, b in zip(order, base[:-1], strict=True)])[base[of] + index]] = np.arange(base[-1])
            sides.append((rank, common))
        columns = [np.concatenate([g[k] for g in got]) for k in range(4)]
        found = repeats(columns[0], columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), *sides)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)

    now, held = None, []
    for batch in batches:
        for bucket, kind, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if kind == 1:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(p, np.int64)) for p in _unpack(run.as_py(), 3)], names)
                continue
            if bucket != now and held:
                yield settle(held)
                held = []
            now = bucket
            held.append(run.as_py())
    if held:
        yield settle(held)


def _numbers(keys: DataFrame) -> DataFrame:
    """i, g, key: the rank of every (doc_id, null last, digest). Ids are dealt to ranges by quantiles, numbered within
    a range, and ranges are offset by what comes before."""
    from .fingerprints import splits_of

    ids = keys.select("doc_id", "digest").distinct()
    splits = splits_of(ids, partitions(keys.sparkSession))
    part = F.when(F.col("doc_id").isNull(), len(splits) + 1).otherwise(range_of(F.col("doc_id"), splits))
    ids = cut(ids.withColumn("part", part.cast("int")))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = ids.groupBy("part").agg(F.count("*").alias("n")).select(F.col("part").alias("p"), before.alias("before"))
    number = F.row_number().over(W.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_last(), "digest"))
    ranked = ids.withColumn("number", number).join(offset, F.col("part") == F.col("p"))
    return cut(ranked.select(F.col("doc_id").alias("i"), F.col("digest").alias("g"), (F.col("number") + F.col("before")).cast("long").alias("key")))


def _marked(df: DataFrame, id_col: str, text_col: str, rows: bool) -> DataFrame:
    """Each row with __whole (all of it repeats an earlier text), __starts and __ends (byte spans that go and may
    overlap): with doc_id and text only or, if ``rows``, all columns of ``df``."""
    spark = df.sparkSession
    n = partitions(spark)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    digest = lambda text: F.unhex(F.sha2(F.encode(text, "utf-8"), 256))
    keys = cut(docs.select("doc_id", digest(F.col("text")).alias("digest"), (F.octet_length("text") >= LENGTH).alias("long")))
    counts = keys.agg(F.count("*").alias("rows"), F.count("doc_id").alias("named")).first()
    unique = counts["rows"] == counts["named"] and keys.groupBy("doc_id").count().where("count > 1").isEmpty()
    if unique:
        # The same columns and filter at each use of base, so that Spark deals the texts out once.
        of = keys.select(F.col("doc_id").alias("key"), "digest", "long")
        base = docs.where("doc_id is not null").select(F.col("doc_id").alias("key"), "text").repartition(n, "key")
    else:
        numbers = _numbers(keys)
        of = keys.join(numbers, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("g"))).select("key", "digest", "long")
        base = docs.join(numbers, F.col("doc_id").eqNullSafe(F.col("i")) & (digest(F.col("text")) == F.col("g"))).where("key is not null").select("key", "doc_id", "text").repartition(n, "key")
    # Kept, so that its join is one of two exchanges, whose large groups of copies Spark can split.
    firsts = cut(of.where("long").groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = cut(of.join(firsts, "digest").where("key > first").select(F.col("key").alias("copy")).distinct())
    # Not an anti-join, which Spark would move below the exchange of base; so all uses of base share one exchange.
    rest = base.join(copies, F.col("key") == F.col("copy"), "left").where("copy is null").drop("copy")
    if not unique:
        rest = rest.dropDuplicates(["key"])
    grams = rest.select("key", "text").mapInArrow(_candidates, "route long, key long, at long")
    again = grams.withColumn("n", F.count("*").over(W.partitionBy("route"))).where("n > 1 or at % 2 = 1")
    places = again.groupBy("key").agg(F.collect_list(F.shiftright("at", 1)).alias("places")).withColumnRenamed("key", "k")
    texts = base if unique else rest
    runs = texts.join(places, F.col("key") == F.col("k")).select("key", "text", "places").mapInArrow(_runs(4 * n), "bucket int, kind int, run binary")
    found = runs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_merged, "key long, start long, end long")
    spans = found.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("__spans")).withColumnRenamed("key", "__k")
    copies = copies.withColumnRenamed("copy", "__copy")
    if rows:
        all_ = [F.col(f"`{c}`") for c in df.columns]
        if unique:
            left = df.withColumn("__key", F.col(f"`{id_col}`").cast("long"))
        else:
            named = numbers.toDF("__i", "__g", "__key")  # no column of df
            own, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
            left = df.join(named, own.eqNullSafe(F.col("__i")) & (digest(text) == F.col("__g"))).select(*all_, "__key")
    else:
        left = base.withColumnRenamed("key", "__key")
        all_ = [F.col("__key" if unique else "doc_id").alias("doc_id"), F.col("text")]
    marked = left.join(spans, F.col("__key") == F.col("__k"), "left").join(copies, F.col("__key") == F.col("__copy"), "left")
    return marked.select(*all_, F.col("__copy").isNotNull().alias("__whole"), F.col("__spans.start").alias("__starts"), F.col("__spans.end").alias("__ends"))


def _texts(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Blocks of :func:`_marked` rows, and of every row the text's bytes and which of them stay."""
    for batch, buf, at in blocks(batches, text_col):
        whole, *sides = batch.columns[-3:]
        whole, lists = whole.to_pylist(), []
        for side in sides:
            size = side.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            lists.append((side.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])))
        out = []
        for k in range(len(at) - 1):
            data, (starts, ends) = buf[at[k] : at[k + 1]], (v[o[k] : o[k + 1]] for v, o in lists)
            if whole[k]:
                stays = np.zeros(len(data), bool)
            else:
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, starts.astype(np.int64), 1)
                np.add.at(step, ends.astype(np.int64), -1)
                stays = np.cumsum(step)[: len(data)] == 0
            out.append((data, stays))
        yield batch, out


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row for each row of ``df``.

    Null texts are empty; null ids come last. Rows with the same id and text are one document, so both give the same
    result; texts that share an id rank by digest. Texts below LENGTH bytes lose nothing; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, "text"):
            rows = []
            for data, stays in texts:
                spans = int((~stays[1:] & stays[:-1]).sum()) + int(len(stays) > 0 and not stays[0])
                rows.append((len(data), int((~stays).sum()), spans, hashlib.sha256(data[stays].tobytes()).hexdigest()))
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _marked(df, id_col, text_col, False).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``df``, all their columns, without the bytes that go (a character of which a byte goes, goes) and,
    if there is a column ``chars_col``, with their new length in code points.

    Rows that lost all of a text go; rows whose text was null or empty before stay as they were.
    """
    names, schema = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, text_col):
            old, new, keep = batch.column(names.index(text_col)), [], []
            for k, (data, stays) in enumerate(texts):
                if stays.all():
                    new.append(old[k].as_py())
                else:
                    lead = np.flatnonzero((data & 0xC0) != 0x80)
                    whole = np.minimum.reduceat(stays, lead)
                    new.append(data[np.repeat(whole, np.diff(np.append(lead, len(data))))].tobytes().decode("utf-8"))
                keep.append(not len(data) or new[-1] != "")
            columns = batch.columns[: len(names)]
            if chars_col in names:
                at = names.index(chars_col)
                chars = [c if s.all() else len(t) for c, (_, s), t in zip(columns[at].to_pylist(), texts, new, strict=True)]
                columns[at] = pa.array(chars, columns[at].type)
            columns[names.index(text_col)] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return _marked(df, id_col, text_col, True).mapInArrow(run, schema)
