"""Near-duplicates by shingle sets against brute force."""

from __future__ import annotations

import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from cases import documents, empty, odd, prose

from lateweave.llm import resemblance, simhash, stages

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def stays(rows: list[tuple[int, str | None]]) -> set[int]:
    """The least id of each component of all pairs of similarity 0.8 or more."""
    root, sets = {i: i for i, _ in rows}, [shingles(t) for _, t in rows]

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, _) in enumerate(rows):
        for m in range(k):
            if 5 * len(sets[k] & sets[m]) >= 4 * len(sets[k] | sets[m]):
                x, y = sorted((find(i), find(rows[m][0])))
                root[y] = x
    return {find(i) for i in root}


def test_stage_takes_five_words_and_eight_tenths(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = stays([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in stages.near_duplicate_stage(spark, docs, folder).collect()} == want


def test_edited_copies(spark):
    """Copies of each text with so many words changed that some are above 0.8 and some below."""
    rng, rows = np.random.default_rng(3), []
    for g in range(12):
        text = prose(100 + g, 200).split()
        for edits in (0, 1, 2, 3, 4, 5, 8):
            w = list(text)
            for p in rng.choice(200, edits, replace=False):
                w[p] = f"new{g}-{edits}-{p}"
            rows.append((len(rows), " ".join(w), "en", "web"))
    want = stays([(i, t) for i, t, _, _ in rows])
    assert 12 < len(want) < 60
    assert {r["doc_id"] for r in resemblance.keep_one(documents(spark, rows)).collect()} == want


def test_odd_rows(spark):
    kept = resemblance.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([None, -5, 1, 4, 5, 6, 8, 8, 10, 11])
    assert resemblance.keep_one(empty(spark)).count() == 0


def test_groups_that_no_least_member_connects(spark):
    """Copies of a text with edits of their own: two of them are below 0.8, each and the text above."""
    text = prose(7, 300).split()
    rows = []
    for k in range(20):
        w = list(text)
        for p in np.random.default_rng(k).choice(300, 5, replace=False):
            w[p] = f"own{k}-{p}"
        rows.append((k, " ".join(w), "en", "web"))
    rows.append((99, " ".join(text), "en", "web"))
    assert len(stays([(i, t) for i, t, _, _ in rows[:-1]])) > 5
    want = stays([(i, t) for i, t, _, _ in rows])
    assert want == {0}
    assert {r["doc_id"] for r in resemblance.keep_one(documents(spark, rows)).collect()} == want


def test_one_row_of_each_group_stays(spark):
    """Whatever ids are: repeated ones, null ones, and one id in two groups."""
    a, b = prose(1, 50), prose(2, 50)
    rows = [(1, a), (1, a), (1, b), (None, b), (None, prose(3, 50)), (None, prose(3, 50)), (2, a)]
    for keep in (resemblance.keep_one, simhash.keep_one):
        kept = keep(documents(spark, [(*r, "en", "s") for r in rows])).collect()
        assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(1, a), (1, b), (None, prose(3, 50))])


def test_buckets_are_connected_over_others():
    sets = [np.arange(a, a + 100, dtype="<u4").tobytes() for a in (0, 10, 20, 500)]
    assert {frozenset(x) for x in resemblance.forest([7, 3, 5, 1], sets, 0.8)} == {frozenset((7, 3)), frozenset((3, 5))}


def test_blocks_of_a_group_meet(spark):
    """However small the blocks are: what they link has the components of all pairs, and no block grows with its group."""
    rng = np.random.default_rng(9)
    sets, roots = {}, {}
    for k in range(60):
        at = int(rng.integers(0, 60)) * 8 if k % 3 else 5000
        sets[k] = np.arange(at, at + 100, dtype="<u4")
        roots[k] = 2 if not k % 3 else k
    pairs = [(a, b) for a in sets for b in sets if a < b and (both := len(np.intersect1d(sets[a], sets[b]))) >= 0.8 * (200 - both)]
    same = [(2, k) for k, r in roots.items() if r == 2]
    members = spark.createDataFrame([(5, k, roots[k], sets[k].tobytes()) for k in sets], "grp long, node long, root long, grams binary")
    for block in (1, 2000, 1 << 18):
        met: dict = {}
        for r in resemblance.meetings(members, block).collect():
            met.setdefault((r["a"], r["b"]), []).append(r)
        found = []
        for (a, b), rows in met.items():
            rows.sort(key=lambda r: r["side"])
            first = None if a == b else sum(r["side"] == 0 for r in rows)
            found += resemblance.forest([r["node"] for r in rows], [bytes(r["grams"]) for r in rows], 0.8, [r["root"] for r in rows], first)
        assert set(found) <= set(pairs)
        assert classes(found + same, sets) == classes(pairs + same, sets)
        assert block > 1 or max(map(len, met.values())) < 20


def classes(links: list[tuple[int, int]], nodes: dict) -> set[frozenset]:
    of = {k: {k} for k in nodes}
    for a, b in links:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for k in of[b]:
                of[k] = of[a]
    return {frozenset(x) for x in of.values()}


def test_a_task_sends_a_set_once(spark):
    """However many copies of a text a task has, over blocks too; sets without a word aren't sent."""
    long = prose(5, 2000)
    rows = [(k, long if k % 3 else prose(k % 2, 40), "en", "web") for k in range(3000)] + [(3000, "", "en", "web")]
    docs = documents(spark, rows).coalesce(1).select("doc_id", "text")
    found = [r["node"] for r in resemblance.with_sets(docs).collect()]
    assert len(found) == len(set(found)) == len({shingles(t) for _, t, _, _ in rows if t})


def segments_near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether some segment of two bytes differs in one bit or none, bit by bit, and all bits are near."""
    differ = [bin(int(a) ^ int(b)).count("1") for a, b in zip(x.view(np.uint16), y.view(np.uint16), strict=True)]
    return min(differ) <= 1 and sum(differ) <= resemblance.FAR


def test_candidates_meet_at_deletion_variants(spark):
    """Fingerprints alone decide: those that share a segment with one bit out, and no others, whatever they are of."""
    rng = np.random.default_rng(4)
    fps = []
    for g in range(30):
        first = rng.integers(0, 256, resemblance.BYTES, dtype=np.uint8)
        fps.append(first)
        for bits in (2, 3, 4):
            # Each segment of the copy differs in so many bits, one segment in exactly one.
            copy = first.view(np.uint16).copy()
            for s in range(len(copy)):
                for p in rng.choice(16, 1 if s == g % 24 and bits < 4 else bits, replace=False):
                    copy[s] ^= np.uint16(1 << int(p))
            fps.append(copy.view(np.uint8))
    hot = rng.integers(0, 256, resemblance.BYTES, dtype=np.uint8)
    for k in range(120):  # more than are compared by shifts
        copy = hot.copy()
        copy[k % resemblance.BYTES] ^= np.uint8(1 << k % 8)
        copy[(k * 7 + 1) % resemblance.BYTES] ^= np.uint8(1 << k % 5)
        fps.append(copy)
    pairs = [(a, b) for b in range(len(fps)) for a in range(b) if segments_near(fps[a], fps[b])]
    apart = [(a, b) for b in range(len(fps)) for a in range(b) if not segments_near(fps[a], fps[b])]
    assert len(pairs) > 5000 and sum(a // 4 == b // 4 < 30 for a, b in apart) > 30
    nodes = spark.createDataFrame([(k, k, x.tobytes()) for k, x in enumerate(fps)] + [(900, 900, None)], "node long, first_id long, signature binary")
    found = [(r["src"], r["dst"]) for r in resemblance.candidates(nodes).collect()]
    assert all(a < b for a, b in found)
    assert classes(found, dict.fromkeys(range(len(fps)))) == classes(pairs, dict.fromkeys(range(len(fps))))


def test_pairs_at_eight_tenths_are_found():
    """Of random sets with a resemblance of just 0.8, 0.99 or more are candidates; unrelated sets aren't."""
    rng = np.random.default_rng(6)
    h, heads = [], [0]
    for _ in range(300):
        both, own = rng.integers(0, 1 << 63, 80).astype(np.uint64), rng.integers(0, 1 << 63, 20).astype(np.uint64)
        for part in (own[:10], own[10:]):
            h += [both, part]
            heads.append(heads[-1] + 90)
    fps = resemblance.signatures(np.concatenate(h), np.array(heads))
    met = set()
    for byte in range(resemblance.BYTES):
        key = byte << 8 | np.ascontiguousarray(fps).view(np.uint8)[:, byte].astype(np.int32)
        order = np.argsort(key, kind="stable")
        a, b = resemblance.near(key[order], fps[order], 64)
        met |= {(min(x, y), max(x, y)) for x, y in zip(order[a].tolist(), order[b].tolist(), strict=True)}
    assert sum((2 * k, 2 * k + 1) in met for k in range(300)) >= 297
    assert all(a // 2 == b // 2 for a, b in met)


def test_bytes_are_worked_on_in_tiles():
    """A block of many texts gives what its texts give one by one, in arrays of a tile's size and not of the block's."""
    import tracemalloc

    from lateweave.llm import common, suffix_dedup

    rows = [prose(k, 40 + 37 * k % 900).encode() for k in range(300)] + [b"", b"one", b"two of", b" ", b"x " * 200_000, b""]
    at = np.cumsum([0, *map(len, rows)])
    buf = np.frombuffer(b"".join(rows), np.uint8)
    assert [a for a, _ in common.tiles(at)][1:] == [b for _, b in common.tiles(at)][:-1]
    assert all(b == a + 1 or at[b] - at[a] <= common.TILE for a, b in common.tiles(at))
    for work in (suffix_dedup.anchors, lambda buf, at: resemblance.grams(buf, at)):
        alone = [work(buf[at[k] : at[k + 1]], at[k : k + 2] - at[k]) for k in range(len(rows))]
        doc = np.concatenate([x[0] + k for k, x in enumerate(alone)])
        found = work(buf, at)
        assert np.array_equal(found[0], doc)
        assert np.array_equal(found[-1], np.concatenate([x[-1] for x in alone]))
    texts = np.frombuffer(b"".join(rows[:300]) * 16, np.uint8)
    starts = np.cumsum([0, *map(len, rows[:300] * 16)])
    for work in (suffix_dedup.anchors, resemblance.grams):
        work(texts[:1000], np.array([0, 1000]))
        tracemalloc.start()
        work(texts, starts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 16 * len(texts), (work, most / len(texts))
