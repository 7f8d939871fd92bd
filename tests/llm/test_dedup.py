"""Near-duplicates and repeated substrings against brute force."""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))
from cases import documents, empty, odd, odd_rows, prose

from lateweave.llm import simhash, suffix_dedup
from lateweave.llm.common import raw
from lateweave.llm.queries import QUERIES

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fingerprint(text: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: list[int]) -> dict[int, int]:
    """The least fingerprint that each reaches, over all pairs."""
    root = {f: f for f in fps}

    def find(f: int) -> int:
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def by_hand(rows: list[tuple]) -> Counter:
    fps = [(i, fingerprint(t)) for i, t, *_ in rows]
    root = components(sorted({f for _, f in fps}))
    least = defaultdict(list)
    for i, f in fps:
        if i is not None:
            least[root[f]].append(i)
    return Counter((i, f"{f:016x}", min(least[root[f]], default=None)) for i, f in fps)


def test_groups_of_all_documents(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash_neardup"](spark, folder).collect())
    assert got == by_hand(rows)


def test_groups_of_odd_rows(spark):
    got = Counter((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.near_duplicates(odd(spark)).collect())
    assert got == by_hand(odd_rows())
    kept = simhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([None, -5, 1, 4, 5, 6, 8, 8, 10, 11])
    assert simhash.near_duplicates(empty(spark)).count() == simhash.keep_one(empty(spark)).count() == 0


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
@settings(max_examples=200, deadline=None)
def test_up_to_four_bits_share_a_variant(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f
    keys = simhash.variants(np.array([a, b], np.uint64))
    assert set(keys[0].tolist()) & set(keys[1].tolist())


@pytest.mark.parametrize("small", [8, 2])
def test_links_reach_all_neighbours(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(small)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):  # chains and clusters
        f = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 14))):
            fps.add(f)
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False).tolist():
                f ^= 1 << b
    fps = sorted(fps)
    want = components(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = simhash.components(simhash.links(df)).collect()
    got = defaultdict(set)
    for r in found:
        got[r["root"]].add(r["node"] & ((1 << 64) - 1))
    groups = defaultdict(set)
    for f, r in want.items():
        groups[r].add(f)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in groups.values() if len(g) > 1}


def test_a_long_chain_of_links(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "src long, dst long")
    rows = simhash.components(chain).collect()
    assert {r["root"] for r in rows} == {0} and len(rows) == 301


# Repeated substrings


def removed(rows: list[tuple[int | None, str | None]], length: int = 100) -> dict:
    """(doc_id, text) to (bytes, removed, spans, digest), by a set of all substrings. Equal rows are one document."""
    def rank(r):
        data = (r[1] or "").encode()
        return (r[0] is None, r[0] or 0, hashlib.sha256(data).hexdigest())

    seen, out = set(), {}
    for i, text in sorted(set(rows), key=rank):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out[i, text] = (len(data), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return out


def check(spark, rows: list[tuple[int | None, str | None]]) -> None:
    want = removed(rows)
    got = Counter(tuple(r) for r in suffix_dedup.digests(documents(spark, [(*r, "en", "s") for r in rows])).collect())
    assert got == Counter((i, *want[i, t]) for i, t in rows)


def test_repeats_of_all_documents(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = removed(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op7_suffix_dedup"](spark, folder).collect()}
    assert got == {i: v for (i, _), v in want.items()}


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_random_texts(spark, seed):
    """Passages of about the length that counts, overlapping and within a document, over few letters."""
    rng = np.random.default_rng(seed)
    letters = list("ab" if seed % 2 else "abcdefgü ")
    passages = ["".join(rng.choice(letters, int(n))) for n in rng.integers(60, 260, 12)]
    rows = []
    for i in range(60):
        parts = [passages[int(k)][int(rng.integers(0, 30)) :] if rng.random() < 0.6 else "".join(rng.choice(letters, int(rng.integers(0, 90)))) for k in rng.integers(0, 12, int(rng.integers(0, 7)))]
        rows.append((int(rng.integers(0, 1000)) * 2 + (1 if i % 2 else 0), "".join(parts)))
    if seed < 2:
        rows = list({i: (i, t) for i, t in rows}.values())
    check(spark, rows)


def test_repeats_of_periods_and_odd_rows(spark):
    check(spark, [(1, "a" * 350), (2, "ab" * 300), (3, "a" * 99), (4, "a" * 100), (5, "ba" * 60), (6, "x" * 40 + "ab" * 50), (7, "中" * 34), (8, "中" * 33 + "é" * 60)])
    check(spark, [(i, t if len(t or "") < 6000 else t[:6000]) for i, t, *_ in odd_rows()])


def test_small_runs_and_folded_surroundings(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN", 50)
    line = prose(9, 40)
    check(spark, [(k, prose(k, 5) + line + prose(k + 100, 5)) for k in range(40)])


def test_cleaned(spark):
    passage = prose(3, 60)
    rows = [(1, f"one {passage} end"), (2, f"two {passage} end"), (3, passage), (4, None), (5, ""), (6, "ü" * 120), (7, "xü" + "ü" * 119)]
    df = documents(spark, [(*r, "en", "s") for r in rows])
    out = {r["doc_id"]: r for r in suffix_dedup.cleaned(df).collect()}
    assert out.keys() == {1, 2, 4, 5, 6, 7}
    assert out[1]["text"] == rows[0][1] and out[4]["text"] is None and out[5]["text"] == ""
    assert out[2]["text"].startswith("two") and len(out[2]["text"]) < 20
    assert out[6]["text"] == "ü" and out[7]["text"] == "x"
    assert all(r["n_chars"] == len(r["text"]) for r in out.values() if r["text"] is not None)
    assert suffix_dedup.cleaned(df).columns == df.columns
    assert suffix_dedup.cleaned(empty(spark)).count() == suffix_dedup.digests(empty(spark)).count() == 0


@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=40), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_loser_tree_merge(texts, runs):
    width = 6
    texts = [t.ljust(width, b"\0") for t in texts]
    split = [sorted(texts[k::runs]) for k in range(runs)]
    coded = []
    for some in split:
        rows = np.frombuffer(b"".join(some), np.uint8).reshape(-1, width) if some else np.zeros((0, width), np.uint8)
        if len(rows):
            order, same, rest = suffix_dedup.front_code(rows)
            assert suffix_dedup.strings_of(same, rest, width) == some
            coded.append((some, same.tolist()))
        else:
            coded.append(([], []))
    of, index, common = suffix_dedup.merge(coded, width)
    merged = [split[r][i] for r, i in zip(of, index, strict=True)]
    assert merged == sorted(texts)
    for a, b, n in zip(merged, merged[1:], common[1:], strict=False):
        assert a[:n] == b[:n] and (n == width or a[n] != b[n])


def test_anchors_do_not_depend_on_the_block():
    """The same text in a block of 1 MB and in one of 9 MB."""
    rng = np.random.default_rng(4)
    text = rng.integers(97, 101, 1 << 20).astype(np.uint8).tobytes().decode()
    other = rng.integers(97, 123, 8 << 20).astype(np.uint8).tobytes().decode()
    small = suffix_dedup.anchors(*raw(pa.array([text], pa.large_string())))
    doc, place, *rest = suffix_dedup.anchors(*raw(pa.array([other, text], pa.large_string())))
    mine = doc == 1
    assert (place[mine] - len(other) == small[1]).all() and all((a[mine] == b).all() for a, b in zip(rest, small[2:], strict=True))


def test_frequent_grams_over_blocks(spark, monkeypatch):
    """A passage in every block of a task: after the first, its anchors are dealt by routes of their own."""
    from lateweave.llm.common import blocks

    monkeypatch.setattr(suffix_dedup, "blocks", lambda batches: blocks(batches, most=2000))
    line, rows = prose(9, 60), [(k, f"{prose(k, 20)} {prose(9, 60)} {prose(9, 60)}") for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], ["key", "text"])
    got = pa.Table.from_batches(suffix_dedup._candidates(iter([batch]))).to_pandas()
    assert len(line) > 100 and got.groupby("route").size().max() <= 5 and (got["at"] % 2 == 1).sum() > 400
    check(spark, rows)


def test_anchors_of_equal_windows_are_equal():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 600).astype(np.uint8).tobytes().decode()
    buf, at = raw(pa.array([data, "zz" + data[50:400] + "y"], pa.large_string()))
    doc, place, gram, least, most = suffix_dedup.anchors(buf, at)
    windows = {(d, p - k) for d, p, a, b in zip(doc, place, least, most, strict=True) for k in range(a, b + 1)}
    assert windows == {(0, s) for s in range(501)} | {(1, 600 + s) for s in range(len(data[50:400]) + 3 - 99)}
