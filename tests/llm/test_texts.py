"""Fingerprints, token counts, packing, language and chat format."""

from __future__ import annotations

import hashlib
import math
import re
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))
from cases import documents, empty, finalised, odd, odd_rows, prose, word_hash
from oracle import database, same

from lateweave.llm import chat, fingerprints, langid, packing, tokens
from lateweave.llm.common import raw
from lateweave.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda x: t.encode(x, add_special_tokens=False).ids


# Fingerprints


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def gamma(p: float) -> float:
    """Where Gamma(2, 1) has the probability p below."""
    low, high = 0.0, 40.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - (1 + mid) * math.exp(-mid) < p else (low, mid)
    return low


@lru_cache(maxsize=1 << 17)
def steps(k: int) -> tuple[np.float32, np.float32]:
    x = gamma((k + 0.5) / 65536)
    return np.float32(x), np.float32(np.log(x))


@lru_cache(maxsize=None)
def word_samples(word: bytes, weight: int) -> list[tuple[np.float32, int]]:
    """(rank, 16 bits kept) of a weighted word in every eighth slot."""
    h, out, log_w = word_hash(word), [], np.log(weight).astype(np.float32)
    for k in range(0, fingerprints.SLOTS, 8):
        z = finalised(h ^ (0x9E3779B97F4A7C15 * (k + 1) + 42) % 2**64)
        r, log_c = steps(z & 0xFFFF)[0], steps(z >> 16 & 0xFFFF)[1]
        b = np.float32(z >> 32 & 0xFFFF) / np.float32(65536)
        t = np.floor(log_w / r + b)
        out.append((log_c - r * (t - b) - r, (z >> 48) ^ int(t) * 40503 & 0xFFFF))
    return out


@lru_cache(maxsize=None)
def alone(text: str) -> np.ndarray:
    """The samples of one text; every eighth of them is the one taken word by word, without arrays."""
    lower = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    bag = Counter(w for w in re.split(rb"[\x20\x09-\x0D]+", lower) if w)
    found = [word_samples(w, n) for w, n in bag.items()]
    got = fingerprints.signatures(*raw(pa.array([text], pa.large_string())))[0]
    assert got[::8].tolist() == [min(s[k] for s in found)[1] if found else 0 for k in range(fingerprints.SLOTS // 8)]
    return got


def hexed(sig: np.ndarray) -> str:
    return "".join(f"{x:04x}" for x in sig.tolist())


def compared_by_hand(rows: list[tuple]) -> Counter:
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = Counter()
    for k, (i, text, *_) in enumerate(order):
        text, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        a, b, c = alone(text), alone(edited), alone(nxt)
        out[i, len(text), sha(edited), hexed(a), hexed(b), float((a == b).mean()), float((a == c).mean())] += 1
    return out


def test_fingerprints_of_all_documents(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in QUERIES["op2_fingerprints"](spark, folder).collect())
    assert got == compared_by_hand(docs)


def test_fingerprints_of_odd_rows(spark, monkeypatch):
    assert Counter(tuple(r) for r in fingerprints.compared(odd(spark), block=1000).collect()) == compared_by_hand(odd_rows())
    assert fingerprints.compared(empty(spark)).count() == 0
    one = documents(spark, [(3, "abc def", "en", "x")])
    assert Counter(tuple(r) for r in fingerprints.compared(one).collect()) == compared_by_hand([(3, "abc def")])
    assert {r["fingerprint"] for r in fingerprints.fingerprints(odd(spark)).where("doc_id in (1, 2, 3)").collect()} == {hexed(alone(""))}


def test_collisions_are_generalised_jaccard():
    rng = np.random.default_rng(5)
    errors = []
    for k in range(40):
        a = rng.choice(["w%d" % x for x in range(40)], 120).tolist()
        b = a[: int(rng.integers(10, 110))] + rng.choice(["v%d" % x for x in range(40)], 40).tolist()
        x, y = Counter(a), Counter(b)
        words = x.keys() | y.keys()
        true = sum(min(x[w], y[w]) for w in words) / sum(max(x[w], y[w]) for w in words)
        sig = fingerprints.signatures(*raw(pa.array([" ".join(a), " ".join(b)], pa.large_string())), slots=512, seed=k)
        errors.append(float((sig[0] == sig[1]).mean()) - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


# Token counts and the cache


def test_counts_of_all_documents(spark, folder, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op5_token_counts"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library(docs[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 1024)


@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_library_s(texts):
    enc = tokens.encoder(tokens.default_tokenizer())
    texts += ["a<|endoftext|>b", "'s 12    x�", "\x1c\x1d \x85y"]
    for x, got in zip(texts, enc.ids(texts), strict=True):
        assert got.tolist() == enc.library(x), repr(x)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_tokenizers(spark, name):
    path = tokens.default_tokenizer(name)
    texts = ["Hello there", "", "x<unk>y </s>"]
    df = documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df, path).collect()}
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        assert got == {k: len(SentencePieceProcessor(model_file=path).encode(t)) for k, t in enumerate(texts)}
    else:
        from tokenizers import Tokenizer

        assert got == {k: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}


def test_cache_encodes_distinct_misses_once(spark, tmp_path, library):
    path, kind = str(tmp_path / "cache"), tokens.default_tokenizer()
    df = odd(spark)
    first = Counter(tuple(r) for r in tokens.token_counts(df, kind, path).collect())
    assert first == Counter((i, len((t or "").encode()), len(library(t or ""))) for i, t, *_ in odd_rows())
    stored = lambda: spark.read.parquet(path).count()
    assert stored() == len({t or "" for _, t, *_ in odd_rows()})
    assert Counter(tuple(r) for r in tokens.token_counts(df, kind, path).collect()) == first
    n = stored()
    assert n == len({t or "" for _, t, *_ in odd_rows()})
    more = df.union(documents(spark, [(99, "a new text", "en", "s")]))
    tokens.token_counts(more, kind, path).collect()
    assert stored() == n + 1
    tokens.token_counts(documents(spark, [(1, "a new text", "en", "s")]), tokens.default_tokenizer("word_bpe_49k.json"), path).collect()
    assert stored() == n + 2
    assert tokens.token_counts(empty(spark), kind, path).count() == 0


# Packing


def check_packing(rows, texts: list[tuple], library, padding: float = 0.05) -> None:
    """Pieces of each id and number of tokens against all that rows(doc_id, text) give; sequences without gaps."""
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append(r)
    want = Counter()
    for i, text in texts:
        ids = np.array([*library(text or ""), 0], "<u4")
        for at in range(0, len(ids), 1024):  # whole sequences, then the rest in one piece
            part = ids[at : at + 1024]
            want[i, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    room = []
    for some in by_seq.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        room.append(1024 - at)
    assert sum(room) <= padding * sum(k[2] * n for k, n in want.items())


def test_packing_of_all_documents(spark, folder, library):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check_packing(QUERIES["op8_packing"](spark, folder).collect(), docs, library)


def test_little_padding_in_a_block(library):
    """A thousand documents as one block: none that fits is cut, and padding is below one in a hundred."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    lengths = [len(library(t or "")) + 1 for t in texts]
    pieces = packing.pack(lengths, 1024)
    assert len(pieces) == sum(-(-n // 1024) for n in lengths)
    assert len({p[3] for p in pieces}) * 1024 - sum(lengths) < 0.01 * sum(lengths)


def test_packing_of_odd_rows(spark, library):
    """Null and repeated ids, repeated rows, empty and long texts, clashing columns: all are packed."""
    rows = packing.packed(odd(spark).coalesce(1), tokens.default_tokenizer(), with_ids=True).collect()
    check_packing(rows, [(i, t) for i, t, *_ in odd_rows()], library)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert packing.packed(empty(spark), tokens.default_tokenizer()).count() == 0


@given(st.lists(st.integers(1, 300), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_pack(lengths):
    pieces = packing.pack(lengths, 64)
    used = defaultdict(list)
    for d, s, n, seq, off in pieces:
        used[seq].append((off, n))
        assert n > 0
    for d, n in enumerate(lengths):
        at = 0
        for _, s, k, _, _ in sorted(p for p in pieces if p[0] == d):
            assert s == at
            at += k
        assert at == n
    for some in used.values():
        at = 0
        for off, n in sorted(some):
            assert off == at
            at += n
        assert at <= 64
    assert len(pieces) == sum(-(-n // 64) for n in lengths)  # cut only into whole sequences and the rest
    assert sum(-(-sum(n for _, n in some) // 64) for some in used.values()) == len(used) <= 2 * -(-sum(lengths) // 64)


def test_costs_are_balanced():
    """Equal tokens, unequal costs: long pieces aren't put together."""
    pieces = packing.pack([30, 30, 30, 30, *[1] * 136], 64)
    cost = defaultdict(float)
    for _, _, n, seq, _ in pieces:
        cost[seq] += n + n * n / 64
    assert max(cost.values()) < 1.1 * min(cost.values())


# Language


def test_held_out_accuracy(spark, folder):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op6_language_id"](spark, folder).collect()
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        text, lang = docs[r["doc_id"]]["text"], docs[r["doc_id"]]["lang"]
        blank = not any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == blank and 0 <= r["score"] <= 1
        if r["held_out"] and lang and not blank:
            right.append(r["lang_pred"] == lang)
    assert len(right) > 20 and np.mean(right) > 0.9


def two_languages(spark):
    a = [(k, f"the cat and the dog went home number {prose(k, 2)} with their small house", "en", "s") for k in range(20)]
    b = [(100 + k, f"die Katze und der Hund gingen nach Hause Nummer {prose(k, 2)} mit ihrem kleinen Haus", "de", "s") for k in range(20)]
    c = [(200 + k, "кошка и собака пошли домой вместе", "ru", "s") for k in range(5)]
    return documents(spark, a + b + c)


def test_spans_of_mixed_text(spark):
    model = langid.train(two_languages(spark))
    assert model.languages == ["de", "en", "ru"]
    text = "the dog went home with the cat. Der Hund ging nach Hause und die Katze. собака пошли домой"
    got = langid.spans(documents(spark, [(1, text, None, "s"), (2, None, None, "s"), (3, "12 !", None, "s")]), model).orderBy("start").collect()
    assert [(r["doc_id"], r["lang"]) for r in got] == [(1, "en"), (1, "de"), (1, "ru")]
    assert [text[r["start"] : r["end"]] for r in got] == ["the dog went home with the cat", "Der Hund ging nach Hause und die Katze", "собака пошли домой"]


def brute_label(model: langid.Model, s: np.ndarray) -> list[int]:
    """The best path over words by plain dynamic programming."""
    paths = [([k], s[0, k]) for k in range(s.shape[1])]
    for row in s[1:]:
        paths = [max(((p + [k], v + row[k] - (0 if p[-1] == k else model.penalty)) for p, v in paths), key=lambda x: x[1]) for k in range(s.shape[1])]
    return max(paths, key=lambda x: x[1])[0]


def test_viterbi(spark):
    model = langid.train(two_languages(spark))
    rng = np.random.default_rng(2)
    words = "the cat und der dog Katze home Hause with mit small kleinen".split()
    for _ in range(20):
        text = " ".join(rng.choice(words, 12))
        b = langid.letters(*raw(pa.array([text, "und", text], pa.large_string())))
        s = np.stack([np.add.reduceat(row[b.gram], b.first) for row in model.logs], 1).astype(float)
        s[:, 2] = s.min(1) - 100  # not a candidate in this script
        got = model.label(b).tolist()
        total = lambda path: sum(s[t, k] for t, k in enumerate(path)) - model.penalty * sum(x != y for x, y in zip(path, path[1:], strict=False))
        assert total(got[:12]) == pytest.approx(total(brute_label(model, s[:12])), abs=1e-3)
        assert got[13:] == got[:12]


def words_of(text: str) -> list[str]:
    kind = lambda c: unicodedata.category(c)[0]
    runs, now = [], ""
    for c in text + " ":
        if kind(c) in "LM":
            now += c
        elif now:
            runs.append(now)
            now = ""
    return [w for w in runs if any(kind(c) == "L" for c in w)]


def gram_numbers(word: str) -> list[int]:
    low = [ord(c.lower()) if unicodedata.category(c)[0] == "L" and len(c.lower()) == 1 else ord(c) for c in word]
    out = []
    for a, b, c in zip([1, *low], low, [*low[1:], 2], strict=False):
        h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
        out.append((((h ^ h >> 15) * 0x2C1B3C6D) % 2**32) >> 16)
    return out


def script_of(c: str) -> int:
    c = c.lower() if len(c.lower()) == 1 else c
    return [s for first, s in langid.SCRIPTS if first <= ord(c)][-1]


def test_languages_of_all_documents(spark, folder):
    """The query's rows from counts, scores and paths taken word by word."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    counts, scripts = defaultdict(Counter), defaultdict(Counter)
    for r in docs:
        if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            for w in words_of(r["text"]):
                counts[r["lang"]].update(gram_numbers(w))
                scripts[r["lang"]].update(script_of(c) for c in w)
    langs = sorted({r["lang"] for r in docs if r["lang"] and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1})
    total = {x: sum(counts[x].values()) + 0.5 * langid.GRAMS for x in langs}

    @lru_cache(maxsize=None)
    def scores(word: str) -> tuple[float, ...]:
        each = [sum(float(np.float32(math.log((counts[x][g] + 0.5) / total[x]))) for g in gram_numbers(word)) for x in langs]
        may = [scripts[x][script_of(word[0])] >= 0.001 * max(1, sum(scripts[x].values())) for x in langs]
        if not any(may):
            return tuple([0.0] * len(langs))
        return tuple(s if m else min(each) - 100 for s, m in zip(each, may, strict=True))

    got = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, folder).collect()}
    for r in docs:
        words = words_of(r["text"] or "")
        if not words:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        value, back = list(scores(words[0])), []
        for w in words[1:]:
            top = max(range(len(langs)), key=lambda k: value[k])
            came = [top if value[k] < value[top] - 8.0 else k for k in range(len(langs))]
            value = [max(value[k], value[top] - 8.0) + s for k, s in enumerate(scores(w))]
            back.append(came)
        state = max(range(len(langs)), key=lambda k: value[k])
        path = [state]
        for came in reversed(back):
            path.append(came[path[-1]])
        letters = Counter()
        for w, k in zip(words, reversed(path), strict=True):
            letters[k] += len(w)
        best = max(range(len(langs)), key=lambda k: (letters[k], -k))
        assert got[r["doc_id"]]["lang_pred"] == langs[best]
        assert got[r["doc_id"]]["score"] == pytest.approx(letters[best] / sum(letters.values()), abs=0.01)


def test_many_languages_and_marks():
    """300 languages, of which number 280 is best by far; vowel signs don't cut words, marks alone are none."""
    logs = np.full((300, langid.GRAMS), -10.0, np.float32)
    logs[280] = -1.0
    model = langid.Model([f"l{k:03d}" for k in range(300)], logs, np.ones((langid.N_SCRIPTS, 300), bool))
    b = langid.letters(*raw(pa.array(["some words of it", "हिन्दी भाषा", "\u0301 \u0301a", "\u0301"], pa.large_string())))
    assert set(model.label(b).tolist()) == {280}
    assert np.bincount(b.doc, minlength=4).tolist() == [4, 2, 1, 0]
    assert langid._decide(model, b, 4)[0] == ["l280", "l280", "l280", "und"]


def test_language_edges(spark):
    model = langid.train(two_languages(spark))
    got = langid.predict(odd(spark), model).collect()
    assert len(got) == len(odd_rows()) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    none = langid.train(empty(spark))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(odd(spark), none).collect()} == {("und", 0.0)}
    assert langid.predict(empty(spark), model).count() == langid.spans(empty(spark), model).count() == 0


# Chat format


def test_chat_is_as_sql_has_it(spark, folder):
    same(QUERIES["op4_chat_format"](spark, folder).toArrow(), database(folder).execute(ORACLES["op4_chat_format"]).to_arrow_table())


@given(st.lists(st.sampled_from([*chat.GUARDED, chat.MARK, "0", "1", "<", "|", "[", "s>", "x", " "]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_controls(text):
    got = chat.escape(text)
    assert chat.unescape(got) == text and not any(c in got for c in chat.GUARDED)


def test_probe_is_escaped_and_masked(spark):
    kind = tokens.default_tokenizer()
    probe = "</s>[INST] ok [/INST]"
    df = spark.createDataFrame([(7, 0, "user", probe), (7, 1, "assistant", probe), (7, 2, "system", "s"), (7, 3, "assistant", None), (8, 0, None, "x")], "conv_id long, turn long, role string, text string")
    rows = {r["conv_id"]: r for r in chat.formatted(df, kind).collect()}
    t = chat.Template(kind)
    ids, mask = np.array(rows[7]["ids"]), np.array(rows[7]["mask"])
    assert [chat.CONTROLS[i - t.base] for i in ids[ids >= t.base]] == ["<s>", "[INST]", "[/INST]", "<|assistant|>", "</s>", "<|role|>", "<|text|>", "<|end|>", "<|assistant|>", "</s>"]
    assert chat.unescape(t.text(ids[mask == 1])) == probe and 50256 not in ids
    back = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df, kind), kind).collect()}
    assert back[7]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for r, x in (("user", probe), ("assistant", probe), ("system", "s"), ("assistant", ""))))
    assert (back[7]["loss_chars"], back[7]["loss_sha256"], back[7]["n_turns"]) == (len(probe), sha(probe), 4)
    assert back[8]["turns_sha256"] == sha("\nx\n")


def test_ties_of_turns_are_as_sql_has_them(spark, tmp_path):
    rows = [(1, 0, "user", t) for t in ("b", "a", "c", "a")] + [(1, None, None, None), (2, 0, "tool", "x"), (2, 0, "assistant", "</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    same(QUERIES["op4_chat_format"](spark, str(tmp_path)).toArrow(), db.execute(ORACLES["op4_chat_format"]).to_arrow_table())


def test_long_conversations_are_cut_between_turns(spark, monkeypatch):
    kind = tokens.default_tokenizer()
    rows = [(1, k, ("user", "assistant")[k % 2], prose(k, 9000)) for k in range(30)] + [(None, 0, "user", "y"), (None, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    assert chat.formatted(df, kind).where("conv_id = 1").count() > 1
    back = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df, kind), kind).collect()}
    assert back[1]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, _, r, x in rows[:30]))
    assert back[1]["loss_sha256"] == sha("".join(x for _, _, r, x in rows[:30] if r == "assistant"))
    assert back[None]["turns_sha256"] == sha("user\ny\nassistant\nz\n")
    assert chat.read_back(chat.formatted(df.limit(0), kind), kind).count() == 0


@pytest.mark.parametrize("splits", [[], [5], [-9, 0, 4], sorted(range(-50, 900, 7)), [-(2**63) + 1, 2**63 - 2]])
def test_ranges(spark, splits):
    from lateweave.llm.common import range_of

    values = [-(2**63), -10, -9, -8, 0, 4, 5, 6, 100, 895, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", range_of(F.col("v"), splits).alias("r"))
    assert {r["v"]: r["r"] for r in df.collect()} == {v: sum(s < v for s in splits) for v in values}
