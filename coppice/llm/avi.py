"""AVI motion-JPEG as a media column: writing, RIFF parsing, frame decoding and shots.

Every frame is a baseline greyscale JPEG with a quantiser of ones, so its quantised
coefficients, the unit that JPEG stores, come back exactly. A byte b of the payload
is the coefficient 256 + b: all of these have magnitude category 9, so with the
frame's own Huffman tables (which any decoder reads from the file) a coefficient is
ten bits, a block of 64 is 80 bytes, and a restart interval of one block keeps
blocks independent. Blocks beyond the payload's end are empty (DC 0, end of block).

The reader finds frames through the RIFF index (idx1), decodes their entropy-coded
segments to coefficients, and compares the histograms of neighbouring frames: a shot
begins where the difference exceeds the mean of the last ``MEMORY`` differences by
``FACTOR`` of their deviations, and ``LEAST`` at any rate.

Defined results: a null or empty text is a payload of 64 zero bytes, one frame and
one shot; equal texts give equal media and clips; rows are returned one for one;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.storage import table

BLOCK, SIDE = 64, 64
BLOCKS = SIDE * SIDE // 64
FRAME = BLOCKS * BLOCK
PACKED = 80
FRAME_US = 40_000
BINS, MEMORY, FACTOR, LEAST = 32, 8, 3.0, 0.05
ROWS = 256


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


# Two codes: '0' for category 9 without a run of zeros, '10' for an empty block's DC and its end.
_LENGTHS = bytes([1, 1] + [0] * 14)
HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + _LENGTHS + bytes([9, 0]))
    + _segment(0xC4, b"\x10" + _LENGTHS + bytes([9, 0]))
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)
EMPTY = 0xAF
RESTARTS = (0xD0 + np.arange(BLOCKS) % 8).astype(np.uint8)


def _bits(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) payload bytes -> (n, 80) entropy-coded bytes: 0, then 1 and the byte, per coefficient."""
    a, b, c, d = (blocks[:, k::4] for k in range(4))
    out = np.empty((len(blocks), 16, 5), dtype=np.uint8)
    out[:, :, 0] = 0x40 | a >> 2
    out[:, :, 1] = (a & 3) << 6 | 0x10 | b >> 4
    out[:, :, 2] = (b & 15) << 4 | 0x04 | c >> 6
    out[:, :, 3] = (c & 63) << 2 | 0x01
    out[:, :, 4] = d
    return out.reshape(-1, PACKED)


def _bytes(coded: np.ndarray) -> np.ndarray:
    """The inverse of _bits."""
    v = coded.reshape(-1, 16, 5)
    out = np.empty((len(v), 16, 4), dtype=np.uint8)
    out[:, :, 0] = (v[:, :, 0] & 63) << 2 | v[:, :, 1] >> 6
    out[:, :, 1] = (v[:, :, 1] & 15) << 4 | v[:, :, 2] >> 4
    out[:, :, 2] = (v[:, :, 2] & 3) << 6 | v[:, :, 3] >> 2
    out[:, :, 3] = v[:, :, 4]
    return out.reshape(-1, BLOCK)


def _scan(coded: np.ndarray) -> bytes:
    """Entropy-coded segments of one frame; a coded byte of all ones is followed by a zero."""
    marks = [bytes((0xFF, m)) for m in RESTARTS]
    own = [row.tobytes().replace(b"\xff", b"\xff\0") for row in coded]
    own += [bytes([EMPTY])] * (BLOCKS - len(own))
    return b"".join(x for pair in zip(own, marks, strict=True) for x in pair)[:-2]


def frames_of(payload: np.ndarray) -> list[bytes]:
    """JPEG frames of a payload whose length is a multiple of 64."""
    coded = _bits(payload.reshape(-1, BLOCK))
    full = len(coded) // BLOCKS
    if (coded[:, 4::5] == 0xFF).any():
        return [HEAD + _scan(coded[k : k + BLOCKS]) + b"\xff\xd9" for k in range(0, len(coded), BLOCKS)]
    out = []
    if full:
        body = np.empty((full, BLOCKS, PACKED + 2), dtype=np.uint8)
        body[:, :, :PACKED] = coded[: full * BLOCKS].reshape(full, BLOCKS, PACKED)
        body[:, :, PACKED] = 0xFF
        body[:, :, PACKED + 1] = RESTARTS
        out = [HEAD + row[:-2].tobytes() + b"\xff\xd9" for row in body.reshape(full, -1)]
    if full * BLOCKS < len(coded):
        out.append(HEAD + _scan(coded[full * BLOCKS :]) + b"\xff\xd9")
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], frame_us: int = FRAME_US) -> bytes:
    largest = max(map(len, frames), default=0)
    header = struct.pack("<14I", frame_us, 0, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, frame_us, 1_000_000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", header) + strl)
    chunks = [_chunk(b"00dc", f) for f in frames]
    at, entries = 4, []
    for frame, chunk in zip(frames, chunks, strict=True):
        entries.append(struct.pack("<4s3I", b"00dc", 0x10, at, len(frame)))
        at += len(chunk)
    movi = _chunk(b"LIST", b"movi" + b"".join(chunks))
    body = b"AVI " + hdrl + movi + _chunk(b"idx1", b"".join(entries))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(media: bytes) -> tuple[int, list[bytes]]:
    """(microseconds a frame, frames) of an AVI, through its index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    at, end, frame_us, movi, index = 12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]), 0, None, b""
    while at + 8 <= end:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            frame_us = struct.unpack_from("<I", media, media.index(b"avih", at) + 8)[0]
        elif name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movi is None:
        raise ValueError("no movi list")
    entries = [e for e in struct.iter_unpack("<4s3I", index) if e[0][2:] == b"dc"]
    # Offsets count from the list's name, or in some files from the file's start.
    base = movi if not entries or media[movi + entries[0][2] : movi + entries[0][2] + 4] == entries[0][0] else 0
    return frame_us, [media[base + o + 8 : base + o + 8 + n] for _, _, o, n in entries]


class _Code:
    """A Huffman table of a DHT segment: (length, code) -> symbol."""

    def __init__(self, lengths: bytes, symbols: bytes):
        self.of, code, k = {}, 0, 0
        for length, n in enumerate(lengths, 1):
            for _ in range(n):
                self.of[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1


def decode_scan(frame: bytes) -> np.ndarray:
    """(blocks, 64) quantised zigzag coefficients of a baseline one-component JPEG, bit by bit."""
    at, codes, interval, blocks = 2, {}, 0, 0
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            _, high, wide, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("only one-component frames are decoded")
            blocks = -(-high // 8) * -(-wide // 8)
        elif marker in (0xC1, 0xC2, 0xC3):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _Code(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            dc, ac = codes[body[2] >> 4], codes[0x10 | body[2] & 15]
            break
    data, ended = frame[at:], False

    def bits() -> Iterator[int]:
        nonlocal k
        while True:
            value = data[k]
            if value == 0xFF and data[k + 1]:
                raise ValueError("a marker inside a block")
            k += 2 if value == 0xFF else 1
            yield from (value >> s & 1 for s in range(7, -1, -1))

    def symbol(code: _Code) -> int:
        length = value = 0
        while (length, value) not in code.of:
            length, value = length + 1, value << 1 | next(stream)
            if length > 16:
                raise ValueError("no such code")
        return code.of[length, value]

    def number(size: int) -> int:
        value = 0
        for _ in range(size):
            value = value << 1 | next(stream)
        return value if not size or value >> size - 1 else value - (1 << size) + 1

    out, k, last = np.zeros((blocks, BLOCK), dtype=np.int32), 0, 0
    stream = bits()
    for b in range(blocks):
        if interval and b and b % interval == 0:
            k, last, stream = data.index(b"\xff", k) + 2, 0, None
            stream = bits()
        last += number(symbol(dc))
        out[b, 0] = last
        place = 1
        while place < BLOCK and not ended:
            run = symbol(ac)
            if run == 0:
                break
            place += run >> 4
            if run & 15:
                out[b, place] = number(run & 15)
            place += 1
    return out


def decode_frame(frame: bytes) -> np.ndarray:
    """Payload blocks (n, 64) of a frame; frames as write_avi lays them out are decoded in one step."""
    size = len(frame) - len(HEAD)
    n, odd = divmod(size - 3 * BLOCKS, PACKED - 1)
    if not odd and 0 < n <= BLOCKS and frame.startswith(HEAD) and frame.endswith(b"\xff\xd9"):
        tail = np.frombuffer(frame, np.uint8, offset=len(HEAD))
        rows = tail[: n * (PACKED + 2)].reshape(n, PACKED + 2)
        blank = tail[n * (PACKED + 2) :].reshape(-1, 3)
        coded = np.ascontiguousarray(rows[:, :PACKED])
        units = coded.reshape(-1, 16, 5)
        fixed = [(0, 0xC0, 0x40), (1, 0x30, 0x10), (2, 0x0C, 0x04), (3, 0x03, 0x01)]
        if (
            all((units[:, :, k] & mask == value).all() for k, mask, value in fixed)
            and not (coded[:, 4::5] == 0xFF).any()
            and (rows[:, PACKED] == 0xFF).all() and (blank[:, 0] == EMPTY).all() and (blank[:, 1] == 0xFF).all()
        ):
            return _bytes(coded)
    found = decode_scan(frame)
    found = found[found[:, 0] != 0]
    return (found - 256).astype(np.uint8)


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) frame of each shot, from a row of shares per frame."""
    begins, recent = [0], []
    apart = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    for k, d in enumerate(apart.tolist(), 1):
        if d > LEAST and recent and d > float(np.mean(recent)) + FACTOR * float(np.std(recent)):
            begins.append(k)
            recent = []
        else:
            recent = [*recent[-MEMORY + 1 :], d]
    return list(zip(begins, [*(b - 1 for b in begins[1:]), len(histograms) - 1], strict=True))


def payload_of(data: bytes) -> np.ndarray:
    """The bytes, followed by zeros up to a positive multiple of 64."""
    return np.frombuffer(data + b"\0" * (-len(data) % BLOCK if data else BLOCK), dtype=np.uint8)


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for begin in range(0, big.num_rows, ROWS):
                batch = big.slice(begin, ROWS)
                texts = [x or b"" for x in batch.column(1).to_pylist()]
                media = [write_avi(frames_of(payload_of(x))) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


CLIP = "array<struct<first_frame:int,last_frame:int,start_ms:bigint,end_ms:bigint,peak:int>>"


def decode(media: DataFrame) -> DataFrame:
    """Adds, from the stored bytes alone, sizes and digests and the clips of every row with a media column."""

    def measure(stored: bytes) -> tuple:
        frame_us, frames = read_avi(stored)
        blocks = [decode_frame(f) for f in frames]
        payload = np.concatenate(blocks).ravel()
        of = np.repeat(np.arange(len(blocks)), [b.size for b in blocks])
        counts = np.bincount(of * BINS + (payload >> 3), minlength=len(blocks) * BINS).reshape(-1, BINS)
        spans = shots(counts / counts.sum(axis=1, keepdims=True))
        sums = np.add.reduceat(counts, [a for a, _ in spans], axis=0)
        clips = [
            {"first_frame": a, "last_frame": b, "start_ms": a * frame_us // 1000, "end_ms": (b + 1) * frame_us // 1000, "peak": int(p)}
            for (a, b), p in zip(spans, sums.argmax(axis=1), strict=True)
        ]
        raw = payload.tobytes()
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), clips

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(measure, batch.column(2).to_pylist()), strict=True)) or [()] * 6
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"]
            struct_type = pa.struct([("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("peak", pa.int32())])
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(struct_type)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))],
                names=["doc_id", "n_bytes", *names],
            )

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        f"media_bytes bigint, media_sha256 string, clips {CLIP}",
    )


def clips(media: DataFrame) -> DataFrame:
    """A timed row per shot of every media value."""
    return decode(media).select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")


def op10_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(table(spark, sf_dir, "documents")))
    clip = lambda c: F.concat_ws(":", F.concat_ws("-", c["start_ms"], c["end_ms"]), c["peak"])
    return rows.select("*", F.array_join(F.transform("clips", clip), ",").alias("feature")).drop("clips")
