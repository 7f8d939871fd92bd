"""Language identification of mixed-language texts.

A word (a run of letters and the marks on them) is scored by letter trigrams with its edges, one for each letter, under every candidate
language; the script of its first letter decides which languages are candidates. Viterbi over the words of a document,
with a penalty for each change of language, labels spans; the document's language is the one with most letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, runs, text_frame

GRAMS = 1 << 16
#: First code point of each script range; a range without letters of interest is 0 (other).
SCRIPTS = [(0, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8), (0xA00, 9), (0xA80, 10), (0xB00, 0), (0xB80, 11), (0xC00, 12), (0xC80, 13), (0xD00, 14), (0xD80, 15), (0xE00, 16), (0xE80, 17), (0xF00, 18), (0x1000, 19), (0x10A0, 20), (0x1100, 21), (0x1200, 22), (0x13A0, 0), (0x1780, 23), (0x1800, 0), (0x1C80, 3), (0x1C90, 20), (0x1CC0, 0), (0x1D00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x2DE0, 3), (0x2E00, 0), (0x3040, 24), (0x3100, 0), (0x3130, 21), (0x3190, 0), (0x31F0, 24), (0x3200, 0), (0x3400, 25), (0xA000, 0), (0xA720, 1), (0xA800, 0), (0xAB30, 1), (0xAB70, 0), (0xAC00, 21), (0xD800, 0), (0xF900, 25), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 1), (0xFF66, 24), (0xFFA0, 21), (0x10000, 0), (0x20000, 25), (0x32000, 0)]
N_SCRIPTS = 26


@lru_cache(maxsize=1)
def alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 1 a letter, 2 a mark (vowel signs and accents stand within words), else 0; simple lower case;
    script."""
    chars = [chr(k) for k in range(0x110000)]
    letter = np.fromiter(({"L": 1, "M": 2}.get(unicodedata.category(c)[0], 0) for c in chars), np.uint8, len(chars))
    low = np.arange(0x110000, dtype=np.uint32)
    for k in np.flatnonzero(letter == 1).tolist():
        if len(x := chars[k].lower()) == 1:
            low[k] = ord(x)
    script = np.zeros(0x110000, np.uint8)
    for (a, s), (b, _) in zip(SCRIPTS, [*SCRIPTS[1:], (0x110000, 0)], strict=True):
        script[a:b] = s
    return letter, low, script


@dataclass
class Block:
    """Letters of a block of texts and the words they make; chars: where each text starts, in code points."""

    chars: np.ndarray
    gram: np.ndarray
    script: np.ndarray
    first: np.ndarray  # each word's first letter
    start: np.ndarray  # and code points
    end: np.ndarray
    doc: np.ndarray


def letters(buf: np.ndarray, at: np.ndarray) -> Block:
    letter, low, script = alphabet()
    code = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    count = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = count[at]
    kind = letter[code]
    start, end, doc = runs(kind > 0, chars)
    if (kind == 2).any():  # a run of marks alone is no word
        real = np.add.reduceat(np.append(kind == 1, False), np.stack([start, end], 1).ravel())[::2] > 0 if len(start) else np.zeros(0, bool)
        start, end, doc = start[real], end[real], doc[real]
    size = end - start
    first = np.cumsum(size) - size
    place = np.repeat(start - first, size) + np.arange(int(size.sum()))
    c = low[code[place]] if len(place) else np.zeros(0, np.uint32)
    before, after = np.empty_like(c), np.empty_like(c)
    if len(c):
        before[1:], after[:-1] = c[:-1], c[1:]
        before[first], after[first + size - 1] = 1, 2
    h = before * np.uint32(0x9E3779B1) + c * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return Block(chars, (h >> np.uint32(16)).astype(np.int64), script[c], first, start, end, doc)


@dataclass
class Model:
    """languages in order; log-probabilities [language, gram]; candidates [script, language]."""

    languages: list[str]
    logs: np.ndarray
    candidates: np.ndarray
    penalty: float = 8.0

    def label(self, b: Block) -> np.ndarray:
        """The language of every word of a block."""
        n, k = len(b.start), len(self.languages)
        if not n or not k:
            return np.zeros(n, np.int32)
        s = np.stack([np.add.reduceat(row[b.gram], b.first) for row in self.logs], 1).astype(np.float64)
        allowed = self.candidates[b.script[b.first]]
        s[~allowed.any(1)] = 0.0
        allowed |= ~allowed.any(1, keepdims=True)
        s = np.where(allowed, s, s.min(1, keepdims=True) - 100.0)
        head = np.flatnonzero(np.concatenate([[True], b.doc[1:] != b.doc[:-1]]))
        size = np.diff(np.append(head, n))
        order = np.argsort(-size, kind="stable")
        head, size = head[order], size[order]
        longer = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts with more than t words
        came, best = np.zeros((n, k), bool), np.zeros(n, np.int32)  # changed language before the word, from which
        v = s[head].copy()
        for t in range(1, int(size[0])):
            m = longer[t]
            at, now = head[:m] + t, v[:m]
            top = now.argmax(1)
            jump = now[np.arange(m), top] - self.penalty
            change = now < jump[:, None]
            came[at], best[at] = change, top
            v[:m] = np.where(change, jump[:, None], now) + s[at]
        out = np.zeros(n, np.int32)
        state = v.argmax(1).astype(np.int32)
        for t in range(int(size[0]) - 1, -1, -1):
            m = longer[t]
            at = head[:m] + t
            out[at] = state[:m]
            state[:m] = np.where(came[at, state[:m]], best[at], state[:m])
        return out


def train(df: DataFrame, penalty: float = 8.0, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all rows of ``df`` with a text and a language: trigram and script counts by language, summed by
    Spark; what comes to the driver is at most 65536 counts a language. Rows with null text or language add nothing;
    without any row the model has no language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch, buf, at in blocks(batches):
            b = letters(buf, at)
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            size = b.end - b.start
            which = np.repeat(code[b.doc], size) if len(size) else np.zeros(0, np.int64)
            for k, name in enumerate(names):
                mine = which == k
                add = np.concatenate([np.bincount(b.gram[mine], minlength=GRAMS), np.bincount(b.script[mine], minlength=N_SCRIPTS)])
                total[name] = total.get(name, 0) + add
        for name, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used.astype(np.int32)), pa.array(counts[used].astype(np.int64))], ["lang", "feature", "n"])

    rows = df.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text is not null and lang is not null")
    found = rows.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((len(names), GRAMS + N_SCRIPTS))
    if names:
        place = {x: k for k, x in enumerate(names)}
        counts[[place[x] for x in found["lang"].to_pylist()], found["feature"].to_numpy()] = found["n"].to_numpy()
    grams, scripts = counts[:, :GRAMS], counts[:, GRAMS:]
    logs = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * GRAMS)).astype(np.float32)
    share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
    return Model(names, logs, (share >= 0.001).T.copy(), penalty)


def _decide(model: Model, b: Block, n: int) -> tuple[list[str], np.ndarray]:
    """Language and share of letters of each of the n texts."""
    k = max(1, len(model.languages))
    size = b.end - b.start
    by = np.bincount(b.doc * k + model.label(b), size, minlength=n * k).reshape(n, k)
    total = by.sum(1)
    known = (total > 0) & bool(model.languages)
    lang = [model.languages[x] if y else "und" for x, y in zip(by.argmax(1), known, strict=True)]
    return lang, np.where(known, by.max(1) / np.maximum(1, total), 0.0)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the share of letters in spans of that language), a row for each row of ``df``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was learnt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, at in blocks(batches):
            lang, score = _decide(model, letters(buf, at), len(at) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return text_frame(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def spans(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, lang: the spans of each text, in code points from the first to the last word of one
    language; texts without a letter have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, at in blocks(batches):
            b = letters(buf, at)
            label = model.label(b)
            if not len(label) or not model.languages:
                continue
            head = np.flatnonzero(np.concatenate([[True], (b.doc[1:] != b.doc[:-1]) | (label[1:] != label[:-1])]))
            tail = np.append(head[1:], len(label)) - 1
            doc = b.doc[head]
            columns = [batch.column(0).cast(pa.int64()).take(pa.array(doc)), pa.array(b.start[head] - b.chars[doc]), pa.array(b.end[tail] - b.chars[doc]), pa.array([model.languages[x] for x in label[head]])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "lang"])

    return text_frame(df, id_col, text_col).mapInArrow(run, "doc_id long, start long, end long, lang string")
