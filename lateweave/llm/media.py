"""AVI files of JPEG frames: an index reader, an intra-frame decoder and shots by adaptive histogram differences.

``store`` writes bytes as motion JPEG without loss. The unit is the quantised DCT coefficient: byte b becomes a
coefficient of magnitude category 8 (b - 255 below 128, else b), so each block of 64 bytes is one 8x8 block whose 64
coefficients all take one code bit and eight value bits under the file's own Huffman tables. A restart marker after
every block makes blocks independent. ``read`` parses the RIFF index, decodes the frames and gives the bytes back.

The decoder takes any baseline sequential frame (grey or colour, any sampling, standard tables if a frame has none);
frames written by ``store`` are recognised by their tables and decoded by array operations.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, text_frame

UNIT, FRAME, RATE = 64, 64, 25  # bytes a block, blocks a frame, frames a second
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))
_C = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: From coefficients in zigzag order to the 64 samples of a block.
IDCT = np.einsum("ux,vy->uvxy", _C, _C).reshape(64, 64)[ZIGZAG].astype(np.float32)


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


_TABLES = {0x00: (b"\1" + bytes(15), b"\x08"), 0x10: (b"\1\1" + bytes(14), b"\x08\x00")}
_HEAD = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64)
_TAIL = b"".join(_segment(0xC4, bytes([k]) + a + b) for k, (a, b) in _TABLES.items()) + _segment(0xDD, b"\0\1") + _segment(0xDA, b"\1\1\0\0\x3f\0")


def frame(payload: np.ndarray) -> bytes:
    """A JPEG of one row of blocks that holds ``payload``, a whole number of 64-byte units."""
    n = len(payload) // UNIT
    bits = np.zeros((n, UNIT, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(payload).reshape(n, UNIT, 8)
    flat = np.packbits(bits.reshape(n, -1), axis=1).ravel()
    wide = 1 + (flat == 0xFF)
    place = np.cumsum(wide) - wide + 2 * (np.arange(len(flat)) // 72)
    out = np.zeros(int(wide.sum()) + 2 * (n - 1), np.uint8)
    out[place] = flat
    ends = (place[71::72] + wide[71::72])[: n - 1]
    out[ends], out[ends + 1] = 0xFF, 0xD0 + np.arange(n - 1) % 8
    size = _segment(0xC0, struct.pack(">BHHB3B", 8, 8, 8 * n, 1, 1, 0x11, 0))
    return _HEAD + size + _TAIL + out.tobytes() + b"\xff\xd9"


def avi(frames: list[bytes], width: int, height: int, rate: int = RATE) -> bytes:
    """A RIFF AVI with one MJPG stream and an idx1 index."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    most = max(map(len, frames), default=0)
    head = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    shape = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    lists = chunk(b"LIST", b"hdrl" + chunk(b"avih", head) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", shape)))
    index, body, at = [], [b"movi"], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(chunk(b"00dc", f))
        at += len(body[-1])
    return chunk(b"RIFF", b"AVI " + lists + chunk(b"LIST", b"".join(body)) + chunk(b"idx1", b"".join(index)))


def store(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of 64, as AVI."""
    padded = np.frombuffer(data + bytes(-len(data) % UNIT or (UNIT if not data else 0)), np.uint8)
    step = UNIT * FRAME
    return avi([frame(padded[k : k + step]) for k in range(0, len(padded), step)], 8 * min(FRAME, len(padded) // UNIT), 8)


def _parts(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the content of each chunk of a stretch; a list's name is its type, after ``LIST``'s."""
    while at + 8 <= min(end, len(data)):
        name, size = struct.unpack_from("<4sI", data, at)
        if name in (b"LIST", b"RIFF"):
            yield name + data[at + 8 : at + 12], at + 12, min(end, at + 8 + size)
        else:
            yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


def _indexed(data: bytes, at: int) -> list[tuple[int, int]]:
    """(offset, size) of the chunks that an OpenDML index names, itself or over the indexes it names."""
    _, _, kind, n, _ = struct.unpack_from("<HBBI4s", data, at)
    if kind == 0:
        each = [struct.unpack_from("<QII", data, at + 24 + 16 * k)[0] for k in range(n)]
        return [x for o in each for x in _indexed(data, o + 8)]
    base = struct.unpack_from("<Q", data, at + 12)[0]
    entries = [struct.unpack_from("<II", data, at + 24 + 8 * k) for k in range(n)]
    return [(base + o, size & 0x7FFFFFFF) for o, size in entries]


def chunks(data: bytes) -> tuple[list[tuple[int, int]], int]:
    """(offset, size) of every chunk of the first video stream, and frames a second times 1000.

    From the stream's OpenDML index if it has one; else, in a file of one RIFF, from idx1, whose offsets may count from
    the file's start or from ``movi``; else the movi lists of all RIFFs are walked, with the ``rec`` lists in them.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, kinds, movies, idx1, supers, riffs = 0, [], [], None, {}, 0
    todo = [x for x in _parts(data, 0, len(data)) if x[0] in (b"RIFFAVI ", b"RIFFAVIX")]
    riffs = len(todo)
    while todo:
        _, start, end = todo.pop(0)
        for name, a, b in _parts(data, start, end):
            if name == b"LISTmovi":
                movies.append((a, b))
            elif name[:4] == b"LIST":
                todo.append((name, a, b))
            elif name == b"avih":
                us = struct.unpack_from("<I", data, a)[0]
                rate = round(1e9 / us) if us else 0
            elif name == b"strh":
                kinds.append(data[a : a + 4])
            elif name == b"indx" and kinds:
                supers[len(kinds) - 1] = a
            elif name == b"idx1":
                idx1 = (a, min(len(data), b))
    if not movies:
        raise ValueError("no movi list")
    stream = kinds.index(b"vids") if b"vids" in kinds else 0
    wanted = lambda name: name in (b"%02ddc" % stream, b"%02ddb" % stream)
    if stream in supers and (out := _indexed(data, supers[stream])):
        return out, rate
    if idx1 and riffs == 1:
        entries = [struct.unpack_from("<4sIII", data, k) for k in range(idx1[0], idx1[1] - 15, 16)]
        base = 0 if entries and data[entries[0][2] : entries[0][2] + 4] == entries[0][0] else movies[0][0] - 4
        return [(base + o + 8, n) for name, _, o, n in entries if wanted(name)], rate
    out, todo = [], [*movies]
    while todo:
        for name, a, b in _parts(data, *todo.pop(0)):
            if name == b"LISTrec ":
                todo.append((a, b))
            elif wanted(name):
                out.append((a, b - a))
    return sorted(out), rate


# The standard Huffman tables of baseline JPEG, as code counts by length and symbols, by class and id.
STANDARD = {
    0x00: (
        bytes.fromhex("00 01 05 01 01 01 01 01 01 00 00 00 00 00 00 00"),
        bytes.fromhex(
            "00 01 02 03 04 05 06 07 08 09 0a 0b "
        ),
    ),
    0x01: (
        bytes.fromhex("00 03 01 01 01 01 01 01 01 01 01 00 00 00 00 00"),
        bytes.fromhex(
            "00 01 02 03 04 05 06 07 08 09 0a 0b "
        ),
    ),
    0x10: (
        bytes.fromhex("00 02 01 03 03 02 04 03 05 05 04 04 00 00 01 7d"),
        bytes.fromhex(
            "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 "
            "22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 "
            "24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 "
            "29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 "
            "4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 "
            "6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 "
            "8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 "
            "a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 "
            "c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 "
            "e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 "
            "f9 fa "
        ),
    ),
    0x11: (
        bytes.fromhex("00 02 01 02 04 04 03 04 07 05 04 04 00 01 02 77"),
        bytes.fromhex(
            "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 "
            "13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 "
            "15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 "
            "27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 "
            "49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 "
            "69 6a 73 74 75 76 77 78 79 7a 82 83 84 85 86 87 "
            "88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 "
            "a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 "
            "c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da "
            "e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 "
            "f9 fa "
        ),
    ),
}


@dataclass
class Frame:
    """coefficients: by component, [rows, columns, 64] as quantised, in zigzag order."""

    width: int = 0
    height: int = 0
    parts: list = field(default_factory=list)  # (id, horizontal, vertical, quantiser)
    quant: dict = field(default_factory=dict)
    coefficients: list = field(default_factory=list)


def _codes(table: tuple[bytes, bytes]) -> dict[tuple[int, int], int]:
    code, out, k = 0, {}, 0
    for n, count in enumerate(table[0], 1):
        for _ in range(count):
            out[n, code] = table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def decode(data: bytes) -> Frame:
    """The coefficients of a baseline JPEG frame."""
    f, tables, interval, at, scan = Frame(), dict(STANDARD), 0, 2, []
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while at + 4 <= len(data):
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                f.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif mark in (0xC0, 0xC1):
            _, f.height, f.width, n = struct.unpack_from(">BHHB", body)
            f.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are intra frames of motion JPEG")
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif mark == 0xDA:
            scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, 0x10 | body[2 + 2 * k] & 15) for k in range(body[0])]
            at += 2 + size
            break
        at += 2 + size
    end = data.rfind(b"\xff\xd9")
    coded = np.frombuffer(data, np.uint8)[at : end if end >= at else len(data)]
    if interval == 1 and len(f.parts) == 1 and {k: tables[k] for k in _TABLES} == _TABLES and (got := _stored(coded)) is not None and len(got) == f.width // 8 * (f.height // 8):
        f.coefficients = [got.reshape(f.height // 8, f.width // 8, 64)]
        return f
    return _entropy(f, coded, scan, {k: _codes(t) for k, t in tables.items()}, interval)


def _stored(coded: np.ndarray) -> np.ndarray | None:
    """[blocks, 64] coefficients if every one is a code bit 0 and eight value bits."""
    mark = np.flatnonzero(coded[:-1] == 0xFF)
    after = coded[mark + 1]
    if not (((after >= 0xD0) & (after <= 0xD7)) | (after == 0)).all():
        return None
    keep = np.ones(len(coded), bool)
    keep[mark + 1] = False
    keep[mark[after != 0]] = False
    flat = coded[keep]
    if len(flat) % 72 or not len(flat):
        return None
    bits = np.unpackbits(flat).reshape(-1, 64, 9)
    if bits[:, :, 0].any():
        return None
    value = np.packbits(bits[:, :, 1:], axis=2)[:, :, 0].astype(np.int16)
    return np.where(value < 128, value - 255, value)


def _entropy(f: Frame, coded: np.ndarray, scan: list, codes: dict, interval: int) -> Frame:
    """Huffman decoding block by block, for frames of any encoder."""
    across, down = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
    wide, high = -(-f.width // (8 * across)), -(-f.height // (8 * down))
    if len(f.parts) == 1:
        across = down = 1
        wide, high, f.parts = -(-f.width // 8), -(-f.height // 8), [(f.parts[0][0], 1, 1, f.parts[0][3])]
    f.coefficients = [np.zeros((high * v, wide * h, 64), np.int32) for _, h, v, _ in f.parts]
    raw, segments, start, k = coded.tobytes(), [], 0, 0
    while (k := raw.find(b"\xff", k)) >= 0:
        if k + 1 < len(raw) and 0xD0 <= raw[k + 1] <= 0xD7:
            segments.append(raw[start:k])
            start = k + 2
        k += 2
    segments.append(raw[start:])
    by = {p[0]: n for n, p in enumerate(f.parts)}
    mcus, n = wide * high, 0
    for s in segments:
        s = s.replace(b"\xff\x00", b"\xff")
        bits, pos, last = int.from_bytes(s, "big"), 8 * len(s), [0] * len(f.parts)

        def take(count: int) -> int:
            nonlocal pos
            pos -= count
            if pos < 0:
                raise ValueError("the frame ends early")
            return (bits >> pos) & ((1 << count) - 1)

        def symbol(table: dict) -> int:
            code = 0
            for length in range(1, 17):
                code = code << 1 | take(1)
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("no such code")

        def signed(size: int) -> int:
            v = take(size) if size else 0
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        for _ in range(min(interval or mcus, mcus - n)):
            for part, dc, ac in scan:
                c = by[part]
                _, h, v, _ = f.parts[c]
                for y in range(v):
                    for x in range(h):
                        block = f.coefficients[c][n // wide * v + y, n % wide * h + x]
                        last[c] += signed(symbol(codes[dc]))
                        block[0], k = last[c], 1
                        while k < 64:
                            rs = symbol(codes[ac])
                            if rs == 0:
                                break
                            k += rs >> 4
                            if rs != 0xF0:
                                block[k] = signed(rs & 15)
                            k += 1
            n += 1
    return f


def luma(f: Frame) -> np.ndarray:
    """The first component's samples, [height, width]."""
    c = f.coefficients[0]
    q = f.quant.get(f.parts[0][3], np.ones(64, np.int32))
    y = (c.reshape(-1, 64) * q).astype(np.float32) @ IDCT + 128
    y = np.clip(np.rint(y), 0, 255).astype(np.uint8).reshape(c.shape[0], c.shape[1], 8, 8).swapaxes(1, 2).reshape(8 * c.shape[0], -1)
    return y[: f.height, : f.width]


def shots(histograms: np.ndarray, window: int = 12, factor: float = 3.0, least: float = 0.2) -> list[tuple[int, int]]:
    """(first, last + 1) frames of each shot of [frames, bins] histograms that sum to 1.

    A shot ends where half the sum of absolute differences to the next frame is above ``least`` and above the mean
    plus ``factor`` standard deviations of the up to ``window`` differences before it.
    """
    if not len(histograms):
        return []
    d = np.abs(np.diff(histograms, axis=0)).sum(1) / 2
    cuts = [0]
    for k, x in enumerate(d):
        past = d[max(cuts[-1], k - window) : k]
        if x > least and (len(past) == 0 or x > past.mean() + factor * past.std()):
            cuts.append(k + 1)
    return list(zip(cuts, [*cuts[1:], len(histograms)], strict=True))


def read(data: bytes) -> tuple[bytes, np.ndarray, list[tuple[int, int]], int]:
    """The stored bytes of a file that :func:`store` wrote, luma histograms [frames, 16], shots, and the frame rate."""
    where, rate = chunks(data)
    frames = [decode(data[a : a + n]) for a, n in where]
    coefficients = np.concatenate([f.coefficients[0].reshape(-1, 64) for f in frames])
    payload = np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8).tobytes()
    hist = histograms(frames)
    return payload, hist, shots(hist), rate


def histograms(frames: list[Frame], bins: int = 16) -> np.ndarray:
    out = np.empty((len(frames), bins))
    for k, f in enumerate(frames):
        y = luma(f)
        out[k] = np.bincount((y >> 4).ravel(), minlength=bins) / y.size
    return out


def media_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text's UTF-8 (null: empty) stored as AVI. Ids and repeats are kept as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, at in blocks(batches):
            data = buf.tobytes()
            files = [store(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(at)), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return text_frame(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def payloads(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back from media: payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (frames, shots and a digest of histograms and clips), n_frames, n_shots, mean_luma (to a
    sixteenth of the scale) and shot_bounds (first and last frame of each shot). :func:`clips` gives a row a shot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part, rows = batch.slice(k, 512), []
                for m in part.column(2):
                    data = m.as_py()
                    payload, hist, found, rate = read(data)
                    seen = hashlib.sha256(np.rint(hist * 1e6).astype("<i8").tobytes() + repr((found, rate)).encode()).hexdigest()
                    bounds, light = ",".join(f"{a}-{b - 1}" for a, b in found), float(hist.mean(0) @ (np.arange(hist.shape[1]) * 16 + 8))
                    digests = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest()
                    rows.append((len(payload), *digests, f"frames={len(hist)};shots={len(found)};look={seen[:16]}", len(hist), len(found), light, bounds))
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_shots", "mean_luma", "shot_bounds"]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_shots long, mean_luma double, shot_bounds string"
    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def clips(df: DataFrame, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """media_id, clip, start_frame, end_frame, start_s, end_s, error: a row for each shot of any motion-JPEG AVI.

    A null file gives no row; one that can't be read gives one row with null times and the reason.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not m.is_valid:
                    continue
                data = m.as_py()
                try:
                    where, rate = chunks(data)
                    hist = histograms([decode(data[a : a + n]) for a, n in where])
                    fps = rate / 1000 or RATE
                    rows += [(i, k, a, b, a / fps, b / fps, None) for k, (a, b) in enumerate(shots(hist))]
                except (ValueError, struct.error, IndexError, KeyError) as e:
                    rows.append((i, None, None, None, None, None, str(e)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, ["media_id", "clip", "start_frame", "end_frame", "start_s", "end_s", "error"])

    from pyspark.sql import functions as F

    two = df.select(F.col(f"`{id_col}`").cast("long").alias("media_id"), F.col(f"`{media_col}`").alias("media"))
    return two.mapInArrow(run, "media_id long, clip long, start_frame long, end_frame long, start_s double, end_s double, error string")
