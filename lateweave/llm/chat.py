"""Chat formatting at token level.

Each text is encoded by itself and reserved ids (above the tokenizer's own) are spliced between, so no text can yield
a control token. In the formatted string control strings stand for those ids; where one occurs in a text it is broken
by an escape that reading undoes. The loss mask of a conversation is the prefix sum of +1 where an assistant's text
begins and -1 where it ends.

    <s> [INST]text[/INST] <|assistant|>text</s> <|role|>name<|text|>text<|end|> ...   (user, assistant, others)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .tokens import encoder

CONTROLS = ("<s>", "[INST]", "[/INST]", "<|assistant|>", "</s>", "<|role|>", "<|text|>", "<|end|>")
#: Strings that a text never holds after escaping: those above and the tokenizer's own special string.
GUARDED = (*CONTROLS, "<|endoftext|>")
MARK = "␛"
#: Tokens of a conversation that one row holds at least before the next begins.
PART = 1 << 16


def escape(text: str) -> str:
    """The mark becomes mark 0; a control string gets mark 1 after its first character."""
    text = text.replace(MARK, MARK + "0")
    for c in GUARDED:
        text = text.replace(c, f"{c[0]}{MARK}1{c[1:]}")
    return text


def unescape(text: str) -> str:
    return text.replace(MARK + "1", "").replace(MARK + "0", MARK)


class Template:
    def __init__(self, tokenizer: str):
        enc = encoder(tokenizer)
        if enc.ranked is None:
            raise ValueError("the template needs a byte-level tokenizer, which gives every text back")
        self.enc, self.base = enc, enc.ranked.n_vocab
        self.id = {c: self.base + k for k, c in enumerate(CONTROLS)}

    def turn(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """Ids of a turn, and from where to where the loss applies."""
        name, body = self.enc.ids([escape(role), escape(text)])
        one = lambda *c: np.array([self.id[x] for x in c], np.uint32)
        if role == "user":
            parts = [one("[INST]"), body, one("[/INST]")]
        elif role == "assistant":
            parts = [one("<|assistant|>"), body, one("</s>")]
        else:
            parts = [one("<|role|>"), name, one("<|text|>"), body, one("<|end|>")]
        loss = (1, 1 + len(body)) if role == "assistant" else (0, 0)
        return np.concatenate(parts), *loss

    def text(self, ids: np.ndarray) -> str:
        return self.enc.ranked.decode_bytes(ids.tolist()).decode("utf-8")


def formatted(df: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part, n_turns, ids, mask: each conversation's tokens and loss mask, in one row or, beyond about
    ``PART`` tokens, in consecutive rows of whole turns (so a conversation of any length takes bounded memory).

    Turns stand in order of turn (null last), then role and text's MD5; repeated rows are turns as well. Null roles and
    texts are empty; rows of a null conv_id are one conversation. Texts are encoded where they are read; only tokens
    are shuffled.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Template(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                got = [t.turn(r, x) for r, x in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                columns = [pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], ["conv_id", "turn", "role", "text", "ids", "a", "b"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Template(tokenizer)
        names = ["conv_id", "part", "n_turns", "ids", "mask"]
        ids: list[np.ndarray] = [np.array([t.id["<s>"]], np.uint32)]
        bounds: list[tuple[int, int]] = []
        conv, part, turns, size, begun = None, 0, 0, 1, False

        def row() -> tuple:
            steps = np.zeros(size + 1, np.int32)
            for a, b in bounds:
                steps[a] += 1
                steps[b] -= 1
            return conv, part, turns, np.concatenate(ids).astype(np.int32), np.cumsum(steps)[:size].astype(np.int8)

        def batch_of(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int8())]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        out, held = [], 0
        for batch in batches:
            flat, at = batch.column(1).flatten().to_numpy(), np.append(0, np.cumsum(batch.column(1).value_lengths().to_numpy()))
            for k, (c, a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                new = begun and c != conv
                if new or size >= PART:
                    out.append(row())
                    held += size
                    ids, bounds, turns, size, part = [], [], 0, 0, part + 1
                    if new:
                        ids, size, part = [np.array([t.id["<s>"]], np.uint32)], 1, 0
                    if held > PART:
                        yield batch_of(out)
                        out, held = [], 0
                conv, begun, turns = c, True, turns + 1
                ids.append(flat[at[k] : at[k + 1]])
                if b > a:
                    bounds.append((size + a, size + b))
                size += int(at[k + 1] - at[k])
        if begun:
            yield batch_of([*out, row()])

    turns = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    coded = turns.mapInArrow(encode, "conv_id long, turn long, role string, text string, ids array<int>, a int, b int")
    n = partitions(df.sparkSession)
    coded = coded.select("conv_id", "turn", "role", F.md5("text").alias("tie"), "ids", "a", "b")
    ordered = coded.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "tie").select("conv_id", "ids", "a", "b")
    return ordered.mapInArrow(assemble, "conv_id long, part int, n_turns long, ids array<int>, mask array<tinyint>")


def read_back(rows: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the tokens and masks of
    :func:`formatted`, whose rows must be in its order (as they are if nothing came between)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Template(tokenizer)
        long = {t.id[c]: c for c in CONTROLS}
        opens = {t.id["[INST]"]: "user", t.id["<|assistant|>"]: "assistant"}
        state: dict = {}
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

        def result() -> dict:
            return {"conv_id": state["conv"], "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["loss_chars"], "loss_sha256": state["loss"].hexdigest(), "formatted_chars": state["chars"]}

        for batch in batches:
            out = []
            for conv, part, ids, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False)
                if part == 0:
                    if state:
                        out.append(result())
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                edge = np.diff(np.concatenate([[0], mask, [0]]))
                for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                    x = unescape(t.text(ids[a:b]))
                    state["loss"].update(x.encode())
                    state["loss_chars"] += len(x)
                role, last = None, 0
                for p in np.flatnonzero(ids >= t.base).tolist():
                    name = long[int(ids[p])]
                    state["chars"] += len(name)
                    between = t.text(ids[last:p])
                    state["chars"] += len(between)
                    last = p + 1
                    if int(ids[p]) in opens:
                        role = opens[int(ids[p])]
                    elif name == "<|text|>":
                        role = unescape(between)
                    elif name in ("[/INST]", "</s>", "<|end|>"):
                        state["turns"].update(f"{role}\n{unescape(between)}\n".encode())
                        state["n"] += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if state:
            yield pa.RecordBatch.from_pylist([result()], schema)

    return rows.select("conv_id", "part", "ids", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
