"""The ordinal classifier, motion JPEG, and the pipeline."""

from __future__ import annotations

import hashlib
import re
import struct
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from cases import documents, empty, finalised, odd, odd_rows, prose, word_hash
from test_dedup import removed
from test_resemblance import stays
from test_texts import check_packing

from lateweave.llm import media, quality, stages, tokens
from lateweave.llm.queries import QUERIES

# Quality


def area(score: np.ndarray, good: np.ndarray) -> float:
    rank = np.argsort(np.argsort(score))
    n = good.sum()
    return (rank[good].sum() - n * (n - 1) / 2) / (n * (~good).sum())


def test_held_out_ratings(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rated = labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    model = quality.train(docs, rated.where("doc_id % 3 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality.score(docs, model).join(rated.where("doc_id % 3 = 0"), "doc_id").where("grade is not null").collect()
    grade = np.array([r["grade"] for r in rows])
    expected, top = (np.array([r[c] for r in rows]) for c in ("expected_grade", "p_top"))
    assert area(top, grade == 2) > 0.9 and area(-expected, grade == 0) > 0.9
    keep = np.array([r["keep"] for r in rows])
    assert keep[grade == 2].mean() > 0.9 and keep[grade < 2].mean() < 0.1


def test_likelihood_gradient():
    """The fit stands where the penalised likelihood no longer grows along any threshold."""
    rng = np.random.default_rng(1)
    n, p = 400, 30
    x = rng.random((n, p)) < 0.3
    score = x[:, :5].sum(1) - x[:, 5:10].sum(1)
    grade = np.digitize(score + rng.logistic(0, 0.5, n), [-0.5, 0.7])
    doc, feature = np.nonzero(x)
    model = quality.fit(doc, feature, grade, rounds=1500)
    got = model.score(doc, feature, n)
    assert np.corrcoef(got, score)[0, 1] > 0.95
    weight = n / np.bincount(grade)
    weight = np.sqrt(weight / weight.min())[grade]

    def loss(theta: np.ndarray) -> float:
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        cdf = lambda t: 1 / (1 + np.exp(-(t - got)))
        return -float((weight * np.log(cdf(edge[grade + 1]) - cdf(edge[grade]))).sum())

    here = loss(model.thresholds)
    for k in range(2):
        for step in (-0.3, 0.3):
            moved = model.thresholds.copy()
            moved[k] += step
            assert loss(moved) > here


def test_quality_edges(spark):
    docs = documents(spark, [(k, prose(k, 20) + (" good" if k % 2 else " bad"), "en", "s") for k in range(60)])
    rated = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 1, 2).otherwise(1).alias("grade"))
    model = quality.train(docs, rated.unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, grade int")))
    got = quality.score(docs, model).collect()
    assert np.mean([r["keep"] == (r["doc_id"] % 2 == 1) for r in got]) > 0.95
    kept = quality.select(odd(spark), model)
    assert kept.columns == odd(spark).columns
    rows = quality.score(odd(spark), model).collect()
    assert len(rows) == len(odd_rows()) and all(r["expected_grade"] == 0 and not r["keep"] for r in rows if r["doc_id"] in (1, 2, 3))
    nothing = quality.train(docs, rated.limit(0))
    assert all(r["keep"] and r["expected_grade"] is None for r in quality.score(docs, nothing).collect())
    assert quality.score(empty(spark), model).count() == quality.select(empty(spark), model).count() == 0
    one = quality.train(docs, rated.where("grade = 2"))
    assert quality.select(docs, one).count() == 60


def test_training_rows_are_bounded(spark, monkeypatch):
    """Rows that repeat an id are one; beyond a number of documents or bytes the rest is left out."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda doc, feature, grade, grades: seen.append((grade, feature)))
    docs = documents(spark, [(k % 30, prose(k % 30, 20), "en", "s") for k in range(3000)])
    rated = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 1, 2).otherwise(1).alias("grade")).distinct()
    quality.train(docs, rated, most=10)
    quality.train(docs.where("doc_id = 3"), rated, most=30)
    quality.train(docs, rated, most=30, most_bytes=1000)
    assert len(seen[0][0]) == 10 and len(seen[1][0]) == 1
    assert 0 < len(seen[2][0]) < 30 and 4 * len(seen[2][1]) <= 1000


def score_by_hand(model: quality.Ordinal, text: str | None) -> tuple[float, float]:
    """Expected grade and probability of the top grade of one text, word by word."""
    data = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    if not words:
        return 0.0, 0.0
    size, full = len(data), (text or "").encode()
    count = lambda codes: sum(c in codes for c in full) / size
    classes = [range(65, 91), b"!?", b"#$%&*@~^_|<>{}[]\\", b"0123456789", b"\n", b".,;:", range(128, 256)]
    found = {word_hash(w) >> (64 - quality.BITS) for w in words}
    shape = [count(set(c)) for c in classes]
    shape += [len(found) / len(words), sum(map(len, words)) / len(words) / 20, np.log2(1 + len(words)) / 20, sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)]
    for k, s in enumerate(shape):
        found.add(finalised(int(sum(x < s for x in quality.STEPS)) + 100 * (k + 1) + (1 << 40)) >> (64 - quality.BITS))
    score = sum(float(model.weights[f]) for f in found)
    above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
    return sum(above), above[-1]


def test_scores_of_all_documents(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(docs, labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade")))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = QUERIES["op3_quality_ordinal"](spark, folder).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(text.keys())
    for r in rows:
        expected, top = score_by_hand(model, text[r["doc_id"]])
        assert (r["expected_grade"], r["p_top"]) == pytest.approx((expected, top), abs=1e-6)
        assert r["keep"] == (r["p_top"] >= 0.5)


def test_same_model_on_each_run(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rated = labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    a, b = quality.train(docs, rated), quality.train(docs.repartition(5), rated.repartition(3))
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


# Media


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def test_payloads_of_all_documents(spark, folder):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op10_media_avi"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        data, whole = docs[r["doc_id"]], padded(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        stored = media.store(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        # What is seen of the frames: a byte below 128 is a coefficient of b - 255, the first of 64 being the mean.
        step, means = 4096, []
        for k in range(0, len(whole), step):
            c = np.frombuffer(whole[k : k + step], np.uint8).reshape(-1, 64).astype(int)
            y = np.clip(np.rint((np.where(c < 128, c - 255, c) @ media.IDCT.astype(float)) + 128), 0, 255)
            means.append(((y // 16) * 16 + 8).mean())
        assert r["n_frames"] == len(means) and r["mean_luma"] == pytest.approx(np.mean(means), abs=0.05)
        shots = [tuple(map(int, x.split("-"))) for x in r["shot_bounds"].split(",")]
        assert len(shots) == r["n_shots"] and [x for a, b in shots for x in range(a, b + 1)] == list(range(r["n_frames"]))
    assert len({(r["payload_sha256"], r["feature"]) for r in rows}) == len({r["payload_sha256"] for r in rows})


@given(st.binary(max_size=300))
@settings(max_examples=100, deadline=None)
def test_bytes_come_back(data):
    assert media.read(media.store(data))[0] == padded(data)


def test_all_bytes_and_frames_come_back():
    data = np.random.default_rng(0).integers(0, 256, 20_000).astype(np.uint8).tobytes() + bytes(range(256)) + b"\xff" * 500
    assert media.read(media.store(data))[0] == padded(data)


def test_general_decoder_agrees_with_the_fast_one(monkeypatch):
    data = bytes(range(256)) * 3
    f = media.store(data)
    fast = [media.decode(f[a : a + n]).coefficients[0] for a, n in media.chunks(f)[0]]
    monkeypatch.setattr(media, "_stored", lambda coded: None)
    slow = [media.decode(f[a : a + n]).coefficients[0] for a, n in media.chunks(f)[0]]
    assert all((a == b).all() for a, b in zip(fast, slow, strict=True))


def flat_jpeg(levels: list[int], tables: bool = False) -> bytes:
    """A grey baseline frame of 8x8 blocks of even brightness, coded with the standard tables (no DHT segment)."""
    codes = {v: (n, c) for (n, c), v in media._codes(media.STANDARD[0x00]).items()}
    end = {v: (n, c) for (n, c), v in media._codes(media.STANDARD[0x10]).items()}[0]
    bits, last = "", 0
    for y in levels:
        dc = (y - 128) // 2  # quantiser 16: 8 * (y - 128) / 16
        d, last = dc - last, dc
        size = abs(d).bit_length()
        n, c = codes[size]
        bits += f"{c:0{n}b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
        bits += f"{end[1]:0{end[0]}b}"
    bits += "1" * (-len(bits) % 8)
    coded = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([16] * 64)) + media._segment(0xC0, struct.pack(">BHHB3B", 8, 8, 8 * len(levels), 1, 1, 0x11, 0))
    return head + media._segment(0xDA, b"\1\1\0\0\x3f\0") + coded + b"\xff\xd9"


def test_frames_of_standard_tables_and_shots(spark):
    levels = [[20, 40, 60]] * 5 + [[200, 220, 240]] * 4 + [[100, 100, 100]] * 3
    frames = [flat_jpeg(x) for x in levels]
    y = media.luma(media.decode(frames[0]))
    assert y.shape == (8, 24) and (y[0, ::8] == [20, 40, 60]).all()
    film = media.avi(frames, 24, 8, 10)
    where, rate = media.chunks(film)
    assert rate == 10_000 and [film[a : a + n] for a, n in where] == frames
    bare = bytearray(film)
    bare[film.rindex(b"idx1") : film.rindex(b"idx1") + 4] = b"JUNK"  # no index: the list is walked
    assert media.chunks(bytes(bare))[0] == where
    df = spark.createDataFrame([(1, film), (2, None), (3, b"RIFF"), (4, b""), (5, film[:200])], "media_id long, media binary").withColumn("clip", F.lit("x"))
    rows = media.clips(df).collect()
    assert [(r["start_frame"], r["end_frame"], r["start_s"], r["end_s"]) for r in rows if r["media_id"] == 1] == [(0, 5, 0.0, 0.5), (5, 9, 0.5, 0.9), (9, 12, 0.9, 1.2)]
    assert {r["media_id"] for r in rows if r["error"]} == {3, 4, 5}


def riff(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def strl(kind: bytes, index: bytes = b"") -> bytes:
    return riff(b"LIST", b"strl" + riff(b"strh", kind + bytes(52)) + (riff(b"indx", index) if index else b""))


def test_frames_in_rec_lists_and_of_one_stream():
    """No index; frames within ``rec`` lists; sound and a second video stream beside them."""
    frames = [flat_jpeg([10 * k]) for k in range(1, 4)]
    recs = b"".join(riff(b"LIST", b"rec " + riff(b"00wb", b"sound") + riff(b"01dc", f) + riff(b"02dc", b"other")) for f in frames)
    head = riff(b"LIST", b"hdrl" + riff(b"avih", struct.pack("<14I", 40_000, *[0] * 13)) + strl(b"auds") + strl(b"vids") + strl(b"vids"))
    film = riff(b"RIFF", b"AVI " + head + riff(b"LIST", b"movi" + recs))
    where, rate = media.chunks(film)
    assert [film[a : a + n] for a, n in where] == frames and rate == 25_000


@pytest.mark.parametrize("indexed", [True, False])
def test_frames_of_several_riffs(indexed):
    """A second RIFF (AVIX), found over the stream's index of indexes or by walking both."""
    frames = [flat_jpeg([10 * k]) for k in range(1, 6)]
    def movi(some):
        body = b"movi" + b"".join(riff(b"00dc", f) for f in some)
        return riff(b"LIST", body)

    def index(base: int, some: list[bytes]) -> bytes:
        at, entries = 12, b""  # within the list: its head, then the chunks
        for f in some:
            entries += struct.pack("<II", at + 8, len(f) | 1 << 31)
            at += len(riff(b"00dc", f))
        return riff(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(some), b"00dc", base, 0) + entries)

    first, second = frames[:3], frames[3:]
    build = lambda places: riff(b"LIST", b"hdrl" + strl(b"vids", struct.pack("<HBBI4s12x", 4, 0, 0, 2, b"00dc") + b"".join(struct.pack("<QII", p, 0, 0) for p in places) if indexed else b""))
    a = 12 + len(build([0, 0]))  # place of the first movi list
    ix_a = a + len(movi(first))
    one = lambda places: riff(b"RIFF", b"AVI " + build(places) + movi(first) + (index(a, first) if indexed else b""))
    b = len(one([0, 0])) + 12
    ix_b = b + len(movi(second))
    film = one([ix_a, ix_b]) + riff(b"RIFF", b"AVIX" + movi(second) + (index(b, second) if indexed else b""))
    assert [film[o : o + n] for o, n in media.chunks(film)[0]] == frames


def test_shots_adapt():
    still = np.eye(4)[[0, 0, 0, 1, 1, 1]]
    assert media.shots(still) == [(0, 3), (3, 6)]
    noisy = np.eye(4)[[0, 1, 0, 1, 0, 1]]
    assert media.shots(noisy)[0] == (0, 1) and media.shots(np.zeros((0, 4))) == []


def test_media_of_odd_rows(spark):
    rows = media.payloads(media.media_of(odd(spark))).collect()
    got = Counter((r["doc_id"], r["payload_sha256"]) for r in rows)
    assert got == Counter((i, hashlib.sha256(padded((t or "").encode())).hexdigest()) for i, t, *_ in odd_rows())
    assert media.payloads(media.media_of(empty(spark))).count() == 0


# Pipeline


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, folder).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def texts(df) -> dict:
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns and after.count() > 0


def test_quality_stage(spark, folder, steps):
    before, after = steps[0]
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = texts(after)
    rated = [r for i, r in labels.items() if i in texts(before)]
    assert not any(r["doc_id"] in kept for r in rated if r["toxic"] == 1)
    good = [r["doc_id"] in kept for r in rated if r["quality"] == 1 and r["toxic"] == 0]
    assert np.mean(good) > 0.95


def test_near_duplicate_stage(steps):
    before, after = steps[1]
    assert set(texts(after)) == stays(list(texts(before).items()))


def test_repeat_stage(steps):
    before, after = steps[2]
    rows = list(texts(before).items())
    got, want = texts(after), removed(rows)
    for i, t in rows:
        n, gone, _, digest = want[i, t]
        if gone == n and n:
            assert i not in got
        elif all(ord(c) < 128 for c in t or ""):
            assert hashlib.sha256((got[i] or "").encode()).hexdigest() == digest
        else:
            assert len((got[i] or "").encode()) <= n - gone


def test_mixing_stage(steps):
    from lateweave.llm import mixing

    before, after = steps[3]
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(before).collect()}
    got = Counter()
    for r in after.collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert got == Counter({i: n for i, n in taken.items() if n})


def test_packing_stage(steps):
    from tokenizers import Tokenizer

    before, after = steps[4]
    t = Tokenizer.from_file(tokens.default_tokenizer())
    want = Counter(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    total = sum(n * k for n, k in want.items())
    rows = after.collect()
    assert sum(r["length"] for r in rows) == total
    used = len({r["sequence_id"] for r in rows})
    assert used * 1024 - total < 1024 * after.rdd.getNumPartitions() + 1024 * 8


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_all_stages_on_odd_rows(spark, folder, rows):
    """Every stage takes what the one before left, and nulls, repeats and clashing columns as they are."""
    import corpus_pipeline

    docs = {"odd": odd, "empty": empty}[rows](spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.toArrow(), docs.schema)
        assert name == "packing" or docs.columns == columns, name
    if rows == "empty":
        assert docs.isEmpty()


def test_run_is_the_stages_in_turn(spark, folder, steps):
    import corpus_pipeline

    show = lambda df: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    a, b = show(corpus_pipeline.run(spark, folder)), show(steps[-1][1])
    by_doc = lambda c: Counter(k[0] for k in c)
    assert set(by_doc(a)) == set(by_doc(b))
    assert sum(k[2] * n for k, n in a.items()) == sum(k[2] * n for k, n in b.items())


def test_names_of_stages():
    import corpus_pipeline

    assert [f for _, f in corpus_pipeline.STAGES] == [stages.quality_stage, stages.near_duplicate_stage, stages.repeat_stage, stages.mixing_stage, stages.packing_stage]
    assert check_packing
