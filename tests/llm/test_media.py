"""Media columns: exact round trips and damaged containers."""

import hashlib
import struct
import zlib

import pytest

from leafmill.llm import media


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 32, 576 * 32 + 1, 576 * 100 + 5, 2_000_000])
def test_round_trip(size):
    data = bytes(k * 7 % 251 for k in range(min(size, 5000))) * (size // 5000 + 1)
    payload = media.filled(data[:size])
    assert len(payload) % 576 == 0 and payload and payload[:size] == data[:size] and set(payload[size:]) <= {255}
    stored = media.store(payload)
    track = media.probe(stored)
    assert media.payload(stored, track) == payload
    frames = len(payload) // 576
    assert (track.codec, track.timescale, track.duration, len(track.sizes)) == ("raw ", 8000, frames * 576, frames)
    ranges = track.keyframe_ranges()
    assert len(ranges) == -(-frames // 32)
    assert b"".join(stored[a:b] for a, b in ranges) == b"".join(payload[k * 576 : k * 576 + 576] for k in range(0, frames, 32))


def test_other_layouts():
    """A 64-bit box, 64-bit offsets, own sample sizes, a box to the end of the file."""
    box = lambda kind, *p: struct.pack(">I4s", 8 + sum(map(len, p)), kind) + b"".join(p)
    u = lambda *x: struct.pack(f">{len(x)}I", *x)

    def made(base):
        table = box(b"stbl", box(b"stsd", u(0, 1, 16), b"avc1", bytes(8)), box(b"stts", u(0, 2, 1, 10, 2, 5)), box(b"stsc", u(0, 2, 1, 2, 1, 2, 1, 1)), box(b"stsz", u(0, 0, 3, 3, 2, 4)), box(b"co64", u(0, 2), struct.pack(">2Q", base, base + 7)))
        moov = box(b"moov", box(b"trak", box(b"mdia", box(b"mdhd", u(0, 0, 0, 600, 0, 0)), box(b"minf", table))))
        return box(b"free", b"x") + struct.pack(">I4sQ", 1, b"moov", len(moov) + 8) + moov[8:]

    head = made(0)
    base = len(head) + 8
    stored = made(base) + struct.pack(">I4s", 0, b"mdat") + b"aaabb..cccc"
    track = media.probe(stored)
    assert media.payload(stored, track) == b"aaabbcccc"
    assert (track.codec, track.timescale, track.duration) == ("avc1", 600, 20)
    assert track.keyframe_ranges() == [(base, base + 3), (base + 3, base + 5), (base + 7, base + 11)]


def test_damaged():
    stored = media.store(media.filled(b"text" * 500))
    assert media.probe(None) is None and media.probe(b"") is None and media.probe(b"no container at all") is None
    for cut in range(0, len(stored) - 1, 37):
        assert media.probe(stored[:cut]) is None


def test_query(spark):
    texts = [None, "", "é" * 400, "plain", "plain", "long " * 40_000]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_bytes int, media string")
    rows = {r.doc_id: r for r in media.features(docs).collect()}
    for k, text in enumerate(texts):
        payload = media.filled((text or "").encode())
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.store(payload)), hashlib.sha256(media.store(payload)).hexdigest())
        assert r.feature.startswith(f"raw |8000|{len(payload)}|{len(payload) // 576}|")
    assert rows[3][1:] == rows[4][1:] and rows[0][1:] == rows[1][1:]
    assert media.features(docs.limit(0)).collect() == []
    damaged = spark.createDataFrame([(1, 4, bytearray(b"none")), (2, 4, None)], "doc_id long, n_bytes long, media binary")
    assert [r.codec for r in media.probed(damaged).collect()] == [None, None]
