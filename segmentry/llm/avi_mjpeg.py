"""Media columns: payloads as AVI motion-JPEG, read back frame by frame, and cut into timed clips.

A payload is stored without loss as one grey sample of 8 x 8 equal pixels per byte: a block has a DC
coefficient alone, the quantiser is 8, and so the quantised DC is the byte minus 128. A frame has 64
such blocks (64 x 64 pixels). The Huffman table gives the category of a DC difference 9 minus
category bits, so category and magnitude fill 9 bits whatever the difference, and the end of block
takes the tenth; coding and decoding of any number of blocks are then array operations. The file has
a header list, a `movi` list with a chunk per frame, and an `idx1` index, from which frames are read.

Frames are baseline JPEG in grey. The reader takes the fast way for frames whose tables are as
above, and otherwise decodes the Huffman codes one by one, with AC coefficients and the inverse
transform, so grey frames of other encoders (8 bits, sequential, with or without restarts) are read too.

Shots: the histogram of each frame (16 cells) is compared with the one before by the sum of absolute
differences; a cut is where that sum exceeds mean + SPREAD standard deviations of the WINDOW
sums before it, and LEAST of the samples. Clips are the stretches between cuts.

Results for odd rows: a null payload counts as empty; payloads are padded with bytes 0 to a positive
multiple of 64, so an empty one is one frame; equal payloads give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import per_slice, table

UNIT = 64
SIDE = 64
FPS = 25
CELLS, WINDOW, SPREAD, LEAST = 16, 8, 3.0, 0.25


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Code lengths of the DC categories: 1 bit for category 8 to 9 bits for category 0.
DC_COUNTS, DC_SYMBOLS = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])
HEADER = (
    b"\xff\xd8"
    + segment(0xDB, bytes([0]) + bytes([8] * 64))
    + segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0]))
    + segment(0xC4, bytes([0x00]) + DC_COUNTS + DC_SYMBOLS)
    + segment(0xC4, bytes([0x10]) + AC_COUNTS + AC_SYMBOLS)
    + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def dc_codes() -> np.ndarray:
    """The 10 bits of each difference -255 to 255: category, magnitude, end of block."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        # canonical codes: ones, then a zero; category 0 has eight ones and a zero
        prefix = ((1 << (8 - size)) - 1) << 1
        magnitude = d if d >= 0 else d + (1 << size) - 1
        out[d + 255] = (prefix << size | magnitude) << 1
    return out


DC_CODES = dc_codes()


def dc_values() -> np.ndarray:
    """The difference of each 10 bits; 999 for codes that aren't used."""
    out = np.full(1024, 999, np.int16)
    out[DC_CODES.astype(np.int64)] = np.arange(-255, 256)
    return out


DC_VALUES = dc_values()


def encode_scans(samples: np.ndarray) -> np.ndarray:
    """(frame, 64) samples to (frame, 80) bytes of entropy-coded data, unstuffed."""
    d = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128))
    v = DC_CODES[d + 255].reshape(-1, 4)
    word = v[:, 0] << np.uint64(30) | v[:, 1] << np.uint64(20) | v[:, 2] << np.uint64(10) | v[:, 3]
    return (word << np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].reshape(len(samples), -1)


def decode_scans(data: np.ndarray) -> np.ndarray:
    """The inverse of encode_scans."""
    five = np.zeros((data.size // 5, 8), np.uint8)
    five[:, 3:] = data.reshape(-1, 5)
    word = five.view(">u8").astype(np.uint64).ravel()
    v = np.stack([(word >> np.uint64(s)) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1)
    d = DC_VALUES[v.astype(np.int64)].reshape(len(data), -1)
    return (np.cumsum(d, axis=1, dtype=np.int32) + 128).astype(np.uint8)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """The AVI file of a payload whose length is a positive multiple of 64."""
    scans = encode_scans(np.frombuffer(payload, np.uint8).reshape(-1, UNIT))
    raw, width = scans.tobytes(), scans.shape[1]
    tail = b"\xff\xd9"
    movi, index, at = [b"movi"], [], 4
    for k in range(0, len(raw), width):
        frame = HEADER + raw[k : k + width].replace(b"\xff", b"\xff\x00") + tail
        size = len(frame)
        movi.append(b"00dc" + struct.pack("<I", size) + (frame + b"\0" if size & 1 else frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, size))
        at += 8 + size + (size & 1)
    n = len(index)
    largest = len(HEADER) + 2 * width + 2
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def frame_places(data: bytes) -> list[tuple[int, int]]:
    """(offset, size) of every video frame, from the index, or from the movi list if there is no index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8, size
        elif name == b"idx1":
            index = at + 8, size
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    if index:
        rows = np.frombuffer(data, "<u4", index[1] // 16 * 4, index[0]).reshape(-1, 4)
        video = rows[np.isin(rows[:, 0] >> 16, [int.from_bytes(x, "little") for x in (b"dc", b"db")])]
        # offsets count from the list's name; some writers count from the start of the file
        base = movi[0] if len(video) and data[movi[0] + int(video[0, 2]) : movi[0] + int(video[0, 2]) + 4][2:] in (b"dc", b"db") else 0
        return [(base + o + 8, n) for o, n in video[:, 2:].tolist()]
    out, at = [], movi[0] + 4
    while at + 8 <= movi[0] + movi[1]:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at + 2 : at + 4] in (b"dc", b"db"):
            out.append((at + 8, size))
        at += 8 + size + (size & 1)
    return out


def read_frames(data: bytes) -> np.ndarray:
    """(frame, blocks) mean samples of the 8 x 8 blocks of every frame, decoded from the stored bytes."""
    n, scans, other = len(HEADER), [], {}
    for k, (at, size) in enumerate(frame_places(data)):
        if data.startswith(HEADER, at) and len(scan := data[at + n : at + size - 2].replace(b"\xff\x00", b"\xff")) == UNIT * 10 // 8:
            scans.append(scan)
        else:
            other[k] = block_means(decode_jpeg(data[at : at + size]))
            scans.append(b"")
    fast = decode_scans(np.frombuffer(b"".join(scans), np.uint8).reshape(-1, UNIT * 10 // 8))
    if not other:
        return fast
    rows = iter(fast)
    return np.stack([other[k] if k in other else next(rows) for k in range(len(scans))])


def block_means(image: np.ndarray) -> np.ndarray:
    h, w = image.shape[0] // 8 * 8, image.shape[1] // 8 * 8
    return np.rint(image[:h, :w].reshape(h // 8, 8, w // 8, 8).mean(axis=(1, 3))).astype(np.uint8).ravel()


def zigzag() -> np.ndarray:
    order = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([i * 8 + j for i, j in order])


def decode_jpeg(data: bytes) -> np.ndarray:
    """Grey image of a baseline sequential JPEG with one component."""
    at, tables, quant, restart, shape = 2, {}, {}, 0, None
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts, code, first, codes = body[1:17], 0, 17, {}
                for length, c in enumerate(counts, 1):
                    for s in body[first : first + c]:
                        codes[length, code] = s
                        code += 1
                    first, code = first + c, code << 1
                tables[body[0]] = codes
                body = body[first:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8 or body[5] != 1:
                raise ValueError("only 8-bit grey frames are read")
            shape = struct.unpack(">HH", body[1:5]) + (body[8],)
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only baseline frames are read")
        elif marker == 0xDA:
            dc, ac = tables[body[2] >> 4], tables[0x10 | body[2] & 15]
            break
    import re

    parts = re.split(rb"\xff[\xd0-\xd7]", data[at : data.rindex(b"\xff\xd9")])
    high, wide = -(-shape[0] // 8), -(-shape[1] // 8)
    blocks, order = np.zeros((high * wide, 64)), zigzag()
    done = 0
    for part in parts:
        raw = part.replace(b"\xff\x00", b"\xff")
        bits, n, pos, last = int.from_bytes(raw, "big"), len(raw) * 8, 0, 0

        def take(k):
            nonlocal pos
            pos += k
            return (bits >> (n - pos)) & ((1 << k) - 1) if k else 0

        def symbol(codes):
            code = length = 0
            while True:
                code, length = code << 1 | take(1), length + 1
                if (length, code) in codes:
                    return codes[length, code]

        def number(size):
            v = take(size)
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        for _ in range(restart or high * wide):
            if done == high * wide:
                break
            row = np.zeros(64)
            last += number(symbol(dc))
            row[0] = last
            k = 1
            while k < 64:
                s = symbol(ac)
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    row[k] = number(s & 15)
                k += 1
            blocks[done, order] = row * quant[shape[2]]
            done += 1
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)
    pixels = np.einsum("xu,buv,yv->bxy", basis, blocks.reshape(-1, 8, 8), basis) + 128
    image = np.clip(np.rint(pixels), 0, 255).reshape(high, wide, 8, 8).swapaxes(1, 2).reshape(high * 8, wide * 8)
    return image[: shape[0], : shape[1]]


def shot_starts(samples: np.ndarray) -> np.ndarray:
    """Frames that begin a shot, frame 0 included; samples: (frame, blocks)."""
    n, blocks = samples.shape
    cell = (np.arange(n)[:, None] * CELLS + (samples.astype(np.int64) * CELLS >> 8)).ravel()
    histogram = np.bincount(cell, minlength=n * CELLS).reshape(n, CELLS)
    change = np.abs(np.diff(histogram, axis=0)).sum(axis=1)
    sums = np.concatenate([[0], np.cumsum(change)])
    squares = np.concatenate([[0], np.cumsum(change.astype(np.int64) ** 2)])
    k = np.arange(len(change))
    low = np.maximum(k - WINDOW, 0)
    size = np.maximum(k - low, 1)
    mean = (sums[k] - sums[low]) / size
    spread = np.sqrt(np.maximum((squares[k] - squares[low]) / size - mean**2, 0))
    return np.concatenate([[0], np.flatnonzero((change > mean + SPREAD * spread) & (change > LEAST * blocks) & (k > 0)) + 1])


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % UNIT or (UNIT if not raw else 0))


def store(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media): the AVI file of every payload."""
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def f(ids, texts):
        got = [padded(t) for t in texts]
        return [ids, [n for n, _ in got], [write_avi(p) for _, p in got]]

    return df.select(id_column, text).mapInArrow(per_slice(lambda: f, schema, 64), "id long, n_bytes long, media binary").withColumnRenamed("id", id_column)


def clips(df: DataFrame, media: str = "media", id_column: str = "doc_id") -> DataFrame:
    """A row per shot: (id, clip, first_frame, n_frames, start_s, end_s)."""
    schema = pa.schema([("id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])

    def f(ids, files):
        rows = []
        for i, data in zip(ids, files):
            if data:
                samples = read_frames(data)
                starts = [*shot_starts(samples).tolist(), len(samples)]
                rows += [(i, k, a, b - a, a / FPS, b / FPS) for k, (a, b) in enumerate(zip(starts, starts[1:]))]
        return list(zip(*rows)) if rows else [[] for _ in schema]

    return df.select(id_column, media).mapInArrow(per_slice(lambda: f, schema, 64), "id long, clip int, first_frame int, n_frames int, start_s double, end_s double").withColumnRenamed("id", id_column)


def digest(df: DataFrame) -> DataFrame:
    """The contract's row of every text: it is stored, the stored bytes are read back, and shots are found in what was read."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def one(i, text):
        n, payload = padded(text)
        media = write_avi(payload)
        samples = read_frames(media)
        back = samples.tobytes()
        starts = shot_starts(samples)
        longest = int(np.diff([*starts, len(samples)]).max())
        feature = f"frames={len(samples)};shots={len(starts)};longest={longest};last_cut={int(starts[-1])}"
        return i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature

    return df.select("doc_id", "text").mapInArrow(
        per_slice(lambda: lambda ids, texts: list(zip(*map(one, ids, texts))), schema, 64),
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
