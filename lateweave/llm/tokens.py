"""Token ids and counts of whole texts, and a digest cache of counts.

A tokenizer is a file: ``.json`` (tokenizers), ``.model`` (sentencepiece). A byte-level BPE file whose ids rise with
its merges is the same function as a rank table, which tiktoken runs several times faster; :class:`Encoder` then uses
that and leaves texts it can't take to the file's own library. Ids are those of the library either way: no begin, end
or other added tokens, special strings in a text as the library's default has them, no truncation, no padding.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, cut, fresh_path, text_frame

#: How byte-level BPE cuts texts before it merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_of(path: str) -> str:
    """The tokenizer's version: a digest of its file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _byte_alphabet() -> dict[str, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _rank_table(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and special tokens if the file is plain byte-level BPE with ids in the order of its merges."""
    model, before = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or not a.get("special") for a in added):
        return None
    vocab, special = model["vocab"], {a["content"]: a["id"] for a in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in pairs]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)) or (made and made[0] < 256):
        return None
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
    return (ranks, special) if len(ranks) == 256 + len(pairs) else None


class Encoder:
    """``ids(texts)`` of the tokenizer file at ``path``, an array of 32-bit ids for each text."""

    def __init__(self, path: str, fast: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.ranked = path, None
        self._library = None
        if path.endswith(".json") and fast and (table := _rank_table(json.loads(Path(path).read_text(encoding="utf-8")))):
            import tiktoken

            self.ranked = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=table[0], special_tokens=table[1])

    def library(self, text: str) -> list[int]:
        if self._library is None:
            if self.path.endswith(".model"):
                from sentencepiece import SentencePieceProcessor

                self._library = SentencePieceProcessor(model_file=self.path).encode
            else:
                from tokenizers import Tokenizer

                t = Tokenizer.from_file(self.path)
                t.no_truncation()
                t.no_padding()
                self._library = lambda x: t.encode(x, add_special_tokens=False).ids
        return self._library(text)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for x in texts:
            got = None
            if self.ranked is not None:
                try:
                    got = self.ranked.encode_to_numpy(x, allowed_special="all")
                except BaseException as e:  # a regular expression that gives up panics
                    if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                        raise
            out.append(np.asarray(self.library(x) if got is None else got, np.uint32))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch, _, _ in blocks(batches):
            n = [len(x) for x in enc.ids(batch.column(1).fill_null("").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


CACHE = T.StructType([T.StructField("digest", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokenizer", T.StringType())])


def token_counts(df: DataFrame, tokenizer: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, a row for each row of ``df``.

    Counts are kept at ``cache_path`` (Parquet, by tokenizer version and the SHA-256 of the normalised content: null
    is empty, nothing else changes since counts are of the exact text). Texts whose digest isn't there are encoded
    once each and appended; a second append of a count is harmless, readers fold equal digests. Without a path the
    cache lives in the shared folder for this call alone. A tokenizer file with other content is another version.
    Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows are kept; an empty table gives none.
    """
    spark, version = df.sparkSession, version_of(tokenizer)
    path = cache_path or fresh_path(spark, "token-counts")
    docs = text_frame(df, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("digest", F.sha2(F.encode("text", "utf-8"), 256))
    keys = cut(docs.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))

    def known() -> DataFrame:
        try:
            stored = spark.read.schema(CACHE).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = spark.createDataFrame([], CACHE)
        return stored.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    # One id stands for all that share a digest; joined by both, so that no digest gathers its copies. Only where rows
    # repeat that id as well, their texts meet to become one.
    first = keys.groupBy("digest", "doc_id").agg(F.count("*").alias("n")).groupBy("digest").agg(F.min(F.struct("doc_id", "n")).alias("first"))
    missing = first.join(known().select("digest"), "digest", "left_anti").select(F.col("digest").alias("want"), "first.*").withColumnRenamed("doc_id", "first_id")

    def texts_of(some: DataFrame) -> DataFrame:
        return docs.join(some, (F.col("digest") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").select("digest", "text")

    repeated = missing.where("n > 1")
    texts = texts_of(missing.where("n = 1"))
    if not repeated.isEmpty():
        texts = texts.union(texts_of(repeated).dropDuplicates(["digest"]))
    fresh = texts.mapInArrow(_counted(tokenizer), "digest string, n_tokens long")
    fresh.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(path)
    # Kept, so that its join is one of two exchanges, whose large groups of copies Spark can split.
    return keys.join(cut(known()), "digest", "left").select("doc_id", "n_bytes", "n_tokens")
