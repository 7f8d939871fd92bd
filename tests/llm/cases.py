"""Tables with everything that may go wrong: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

#: Names that operators use inside.
CLASHES = ("key", "fp", "part", "size", "range", "digest", "places", "n", "copy", "first", "h", "rank", "ghost", "features", "gram", "ids", "target", "taken", "w")


def documents(spark, rows: list[tuple], clash: bool = True):
    """documents of (doc_id, text, lang, source), n_chars as it is, and columns under names of ours."""
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"x{c}") for c in CLASHES}) if clash else df


WORDS = [f"w{k}" for k in range(300)]


def prose(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def finalised(h: int) -> int:
    """The 64-bit finaliser of ``common.mix`` in whole numbers."""
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD % 2**64
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 % 2**64
    return h ^ h >> 33


_BYTES = [2 * int(x) + 1 for x in np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64)]


@lru_cache(maxsize=None)
def word_hash(word: bytes) -> int:
    """The hash of a span of bytes, byte by byte."""
    return finalised(sum(_BYTES[b] * pow(0x9E3779B97F4A7C15, k, 2**64) for k, b in enumerate(word)) % 2**64)


def odd_rows() -> list[tuple]:
    long = prose(1, 60_000)
    return [
        (1, None, "en", "web"),
        (2, "", "en", "web"),
        (3, " \t\n\x0b ", None, None),
        (4, "word", "en", "web"),
        (5, "Ünïcödé 中文 \U0001f600 text", "de", "bøøk"),
        (6, long, "en", "web"),
        (7, long, "en", "web"),
        (8, prose(2, 200), "en", None),
        (8, prose(2, 200), "en", None),
        (8, prose(3, 200), None, "web"),
        (None, prose(4, 50), "en", "code"),
        (None, prose(4, 50), "en", "code"),
        (-5, "<|endoftext|> </s>[INST] x", "en", "code"),
        (10, "a" * 5000, "en", "code"),
        (11, "\x00\x7f end", "en", "code"),
    ]


def odd(spark):
    return documents(spark, odd_rows())


def empty(spark):
    return documents(spark, []).limit(0)
