"""Every column of op10's query against a slow decoding of the stored bytes, and the RIFF form itself."""

import hashlib
import random
import struct
import zlib

import numpy as np

from coppice.llm import avi

rng = random.Random(13)


def slow_feature(media):
    frame_us, frames = avi.read_avi(media)
    histograms, payload = [], b""
    for frame in frames:
        units = avi.decode_scan(frame)  # bit by bit
        data = bytes(int(x) - 256 for row in units if row[0] for x in row)
        payload += data
        counts = [0] * avi.BINS
        for b in data:
            counts[b * avi.BINS // 256] += 1
        histograms.append(counts)
    shares = [[c / sum(h) for c in h] for h in histograms]
    begins, recent = [0], []
    for k in range(1, len(shares)):
        d = sum(abs(a - b) for a, b in zip(shares[k], shares[k - 1], strict=True)) / 2
        if d > avi.LEAST and recent and d > np.mean(recent) + avi.FACTOR * np.std(recent):
            begins.append(k)
            recent = []
        else:
            recent = [*recent[-avi.MEMORY + 1 :], d]
    parts = []
    for a, b in zip(begins, [*begins[1:], len(shares)], strict=True):
        total = [sum(h[i] for h in histograms[a:b]) for i in range(avi.BINS)]
        parts.append(f"{a * frame_us // 1000}-{b * frame_us // 1000}:{total.index(max(total))}")
    return payload, ",".join(parts)


def test_query_columns(spark, tmp_path):
    shift = "".join(rng.choice("abcde ") for _ in range(9000)) + "".join(rng.choice("0123456789") for _ in range(9000)) + "é" * 6000
    texts = [None, "", "a", "x" * 64, shift, "\n".join("line %d" % k for k in range(300)), "a"]
    rows = [(k, x, "other") for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in avi.op10_avi_motion_jpeg(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, text, _ in rows:
        data, r = (text or "").encode(), got[k]
        stored = avi.write_avi(avi.frames_of(avi.payload_of(data)))
        payload, feature = slow_feature(stored)
        assert payload == data + b"\0" * (-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), feature)
    plain = lambda r: {k: v for k, v in r.asDict().items() if k != "doc_id"}
    assert plain(got[2]) == plain(got[6]) and plain(got[0]) == plain(got[1]) and "," in got[4]["feature"]


def test_stored_form_is_riff_with_an_index():
    media = avi.write_avi(avi.frames_of(avi.payload_of(b"q" * 50_000)))
    assert media[:4] == b"RIFF" and media[8:12] == b"AVI " and struct.unpack("<I", media[4:8])[0] == len(media) - 8
    at = media.rindex(b"idx1")
    size = struct.unpack("<I", media[at + 4 : at + 8])[0]
    entries = [media[at + 8 + 16 * k : at + 24 + 16 * k] for k in range(size // 16)]
    base = media.index(b"movi")
    for entry in entries:
        name, _, offset, length = struct.unpack("<4sIII", entry)
        frame = media[base + offset + 8 : base + offset + 8 + length]
        assert name == b"00dc" and frame[:2] == b"\xff\xd8" and frame[-2:] == b"\xff\xd9"
    assert len(entries) == len(avi.read_avi(media)[1])
