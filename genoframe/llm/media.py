"""Operator 4: media columns as AVI motion-JPEG, read through the RIFF index, with shots as timed clip rows.

A payload becomes grey frames of 64 samples a line. Frames are lossless JPEG (process 14: left or upper neighbour as
predictor, Huffman-coded differences), so every byte is one 8-bit sample and comes back exactly. The Huffman table is
this module's choice, as in any JPEG: a difference of c bits gets a code of 9 - c bits, so each sample takes nine bits
and whole frames are coded and decoded by numpy at once; other tables are decoded code by code. The file is an AVI
with ``hdrl``, ``movi`` and ``idx1``; the payload's length is in an INFO chunk, as the last frame is filled with 0.

A shot ends where the histogram of a frame differs from the one before by more than the mean and twice the deviation
of the differences around it: the bar adapts to how lively the neighbourhood is.

All work is per row in ``mapInArrow``, nothing is shuffled. Defined cases: null and empty texts are a payload of 64
zero bytes; a media value that is null, truncated or no AVI gives no clips; a very long text is one file of many
frames, held whole by its task at about 40 times its size; a difference that equals the bar is no shot; repeated rows
get equal results; ids of any type come back as they are; an empty table gives none; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from genoframe.llm.common import map_texts, table

WIDTH, HEIGHT, FPS, PAD = 64, 64, 25, 64


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % PAD if data else PAD)


# --- Lossless JPEG ---------------------------------------------------------------------------------------------


@lru_cache(1)
def code_words() -> np.ndarray:
    """The nine bits of each difference, at difference + 255."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = (1 << (9 - c)) - 2 if c else (1 << 9) - 2
        out[d + 255] = prefix << c | (d if d > 0 else d + (1 << c) - 1) if c else prefix
    return out


def dht() -> bytes:
    return b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """JPEG files of frames (count, height, 64), uint8."""
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    bits = np.unpackbits(code_words()[d + 255].astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 7:]
    data = np.packbits(bits).reshape(len(x), -1)
    h = x.shape[1]
    head = b"\xff\xd8" + dht() + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, h, WIDTH, 1, 1, 0x11, 0) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
    return [head + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in data]


@lru_cache(64)
def huffman(table: bytes) -> tuple[dict[tuple[int, int], int], bool]:
    """{(length, code): category} of a DHT body, and whether every sample takes nine bits."""
    counts, symbols = table[:16], table[16:]
    codes, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes, all(length + c == 9 for (length, _), c in codes.items())


@lru_cache(64)
def nine_bits(table: bytes) -> np.ndarray:
    """The difference of each nine-bit word."""
    out = np.zeros(512, np.int16)
    for (length, code), c in huffman(table)[0].items():
        for v in range(1 << c):
            out[code << c | v] = v if c == 0 or v >> (c - 1) else v - (1 << c) + 1
    return out


def differences(data: bytes, table: bytes, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))
    codes, fixed = huffman(table)
    if fixed:
        words = np.zeros((n, 16), np.uint8)
        words[:, 7:] = bits[: 9 * n].reshape(n, 9)
        return nine_bits(table)[np.packbits(words, axis=1).view(">u2")[:, 0]]
    out, at = np.zeros(n, np.int16), 0
    for i in range(n):
        code = length = 0
        while (length, code) not in codes:
            code, length, at = code << 1 | int(bits[at]), length + 1, at + 1
        c = codes[length, code]
        v = int("".join(map(str, bits[at : at + c])), 2) if c else 0
        out[i], at = (v if c == 0 or v >> (c - 1) else v - (1 << c) + 1), at + c
    return out


def decode_frame(jpeg: bytes) -> np.ndarray:
    """The samples (height, width) of a lossless JPEG with one component and predictor 1."""
    at, table, h, w = 2, b"", 0, 0
    while True:
        marker, size = struct.unpack_from(">HH", jpeg, at)
        body = jpeg[at + 4 : at + 2 + size]
        if marker == 0xFFC4:
            table = body[1:]
        elif marker == 0xFFC3:
            h, w = struct.unpack_from(">HH", body, 1)
        at += 2 + size
        if marker == 0xFFDA:
            break
    d = differences(jpeg[at : jpeg.rindex(b"\xff\xd9")], table, h * w).reshape(h, w).astype(np.int32)
    d[:, 0] = np.cumsum(d[:, 0]) + 128
    return (np.cumsum(d, axis=1) & 0xFF).astype(np.uint8)


# --- AVI -------------------------------------------------------------------------------------------------------


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def listed(kind: bytes, *parts: bytes) -> bytes:
    return chunk(b"LIST", kind + b"".join(parts))


def encode_avi(payload: bytes) -> bytes:
    """An AVI file that holds ``payload``, of a positive multiple of 64 bytes."""
    rows = len(payload) // WIDTH
    h = min(HEIGHT, rows)
    n = -(-rows // h)
    frames = np.frombuffer(payload + bytes(n * h * WIDTH - len(payload)), np.uint8).reshape(n, h, WIDTH)
    jpegs = encode_frames(frames)
    most = max(map(len, jpegs))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, WIDTH, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, h, 1, 8, b"MJPG", WIDTH * h, 0, 0, 0, 0)
    movi, index, at = [], [], 4
    for j in jpegs:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(j)))
        movi.append(chunk(b"00dc", j))
        at += len(movi[-1])
    info = listed(b"INFO", chunk(b"ICMT", f"payload_bytes={len(payload)}".encode() + b"\0"))
    return chunk(b"RIFF", b"AVI " + listed(b"hdrl", chunk(b"avih", avih), listed(b"strl", chunk(b"strh", strh), chunk(b"strf", strf))) + info + listed(b"movi", *movi) + chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, size
        at += 8 + size + size % 2


def parse_avi(data: bytes) -> tuple[list[bytes], int | None, float]:
    """The frames that the index lists, the payload's length if it is stored, and seconds a frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, length, seconds = 0, b"", None, 1 / FPS
    for name, at, size in chunks(data, 12, len(data)):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            seconds = next(struct.unpack_from("<I", data, a)[0] for x, a, _ in chunks(data, at + 4, at + size) if x == b"avih") / 1e6
        elif name == b"LIST" and kind == b"INFO":
            length = next((int(data[a : a + s].strip(b"\0").split(b"=")[1]) for x, a, s in chunks(data, at + 4, at + size) if x == b"ICMT"), None)
        elif name == b"LIST" and kind == b"movi":
            movi = at
        elif name == b"idx1":
            index = data[at : at + size]
    frames = [data[movi + off + 8 : movi + off + 8 + size] for fourcc, _, off, size in struct.iter_unpack("<4sIII", index) if fourcc[2:] == b"dc"]
    return frames, length, seconds


def decode_avi(data: bytes) -> tuple[np.ndarray, bytes, float]:
    """Frames (count, height, width), the payload, and seconds a frame."""
    jpegs, length, seconds = parse_avi(data)
    frames = np.stack([decode_frame(j) for j in jpegs])
    return frames, frames.tobytes()[:length], seconds


# --- Shots -----------------------------------------------------------------------------------------------------


def histograms(frames: np.ndarray, bins: int = 16) -> np.ndarray:
    n, size = len(frames), frames[0].size
    keys = (frames.reshape(n, size) >> 4).astype(np.int64) + bins * np.arange(n)[:, None]
    return np.bincount(keys.ravel(), minlength=bins * n).reshape(n, bins) / size


def shot_starts(frames: np.ndarray, reach: int = 8, times: float = 2.0, least: float = 0.05) -> list[int]:
    """First frames of shots."""
    if len(frames) < 2:
        return [0]
    diff = np.abs(np.diff(histograms(frames), axis=0)).sum(1) / 2
    ends = np.concatenate([[0.0], np.cumsum(diff)]), np.concatenate([[0.0], np.cumsum(diff**2)])
    i = np.arange(len(diff))
    low, high = np.maximum(0, i - reach), np.minimum(len(diff), i + reach + 1)
    mean = (ends[0][high] - ends[0][low]) / (high - low)
    spread = np.sqrt(np.maximum(0, (ends[1][high] - ends[1][low]) / (high - low) - mean**2))
    return [0, *(np.flatnonzero(diff > np.maximum(least, mean + times * spread)) + 1).tolist()]


def clip_rows(data: bytes | None) -> list[tuple[int, float, float, int]]:
    """(clip, start_s, end_s, frames) of a media value."""
    try:
        frames, _, seconds = decode_avi(data or b"")
    except (ValueError, struct.error, IndexError):
        return []
    starts = shot_starts(frames)
    return [(k, a * seconds, b * seconds, b - a) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)], strict=True))]


# --- Spark -----------------------------------------------------------------------------------------------------


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, media: each text stored as an AVI file."""
    return map_texts(docs, [text_col], lambda texts: [[encode_avi(pad((t or "").encode("utf-8", "replace"))) for t in texts]], "media binary", [id_col])


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row a clip: id_col, clip, start_s, end_s, frames."""

    def run(values: list) -> list[list]:
        rows = [(i, *r) for i, m in enumerate(values) for r in clip_rows(m)]
        return list(map(list, zip(*rows, strict=True))) if rows else [[]] * 5

    return map_texts(media, [media_col], run, "clip int, start_s double, end_s double, frames int", [id_col])


def digest(text: str | None) -> tuple:
    data = (text or "").encode("utf-8", "replace")
    media = encode_avi(pad(data))
    frames, payload, seconds = decode_avi(media)
    starts = shot_starts(frames)
    feature = f"frames={len(frames)};clips={len(starts)};starts={','.join(f'{s * seconds:.2f}' for s in starts)};mean={frames.mean():.3f}"
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and what ``digest`` says of each text."""
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(docs, [text_col], lambda texts: list(zip(*map(digest, texts), strict=True)) or [[]] * 7, schema, [id_col])


def op4(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
