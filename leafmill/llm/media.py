"""Media columns: ISO base media containers written and walked as bytes.

``store`` wraps a payload as one audio track of 8-bit samples, ``probe`` walks
the nested boxes of any such container, decodes its sample tables and reports
codec, duration and keyframe byte ranges; ``payload`` reads the stored samples
back by those tables. Payloads are never decoded.

Defined cases: a null text is the empty text; the empty payload becomes one
frame of filler; bytes that are no container, or whose tables contradict each
other, make ``probe`` return None (a null struct in the DataFrame form); an
empty table gives an empty result; rows are independent, so ties, repeats and
other columns do not matter; a null doc_id stays null; a very long text is held
twice by one task, as payload and as container.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_out, text_bytes

#: Samples of a frame; a payload is filled up to a positive multiple of it.
FRAME = 576
FILLER = 255
#: Samples a second of the stored track.
RATE = 8000
#: Frames of a chunk; each chunk's first frame is marked as a keyframe.
CHUNK = 32
TAIL = 32

#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}


class Track(NamedTuple):
    """What the boxes of a track say; offsets are those of the container."""

    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    keyframes: np.ndarray

    def keyframe_ranges(self) -> list[tuple[int, int]]:
        starts = self.offsets[self.keyframes]
        return list(zip(starts.tolist(), (starts + self.sizes[self.keyframes]).tolist()))


def filled(data: bytes) -> bytes:
    """The payload of a text: filler up to a positive multiple of a frame."""
    return data + bytes([FILLER]) * (-len(data) % FRAME if data else FRAME)


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return struct.pack(">I4s", size, kind) + b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def store(payload: bytes) -> bytes:
    """A container whose only track holds ``payload`` (whole frames) unchanged."""
    frames, rest = divmod(len(payload), FRAME)
    if rest or not frames:
        raise ValueError("a payload is a positive number of whole frames")
    chunks = -(-frames // CHUNK)
    last = frames - (chunks - 1) * CHUNK
    duration = frames * FRAME
    wide = duration >= 1 << 32
    version, span = (1, ">QQIQ") if wide else (0, ">IIII")
    brand = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, CHUNK, 1)] if last == CHUNK else [(1, last, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, last, 1)]
    sync = np.arange(1, frames + 1, CHUNK, dtype=">u4")

    def head(base: int) -> bytes:
        places = base + np.arange(chunks, dtype=np.int64) * (CHUNK * FRAME)
        far = int(places[-1]) >= 1 << 32
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *run) for run in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64" if far else b"stco", struct.pack(">I", chunks), places.astype(">u8" if far else ">u4").tobytes()),
        )
        sound = _full(b"smhd", bytes(4))
        data = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        handler = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0")
        media = _box(b"mdia", _full(b"mdhd", struct.pack(span, 0, 0, RATE, duration), struct.pack(">HH", 0x55C4, 0), version=version), handler, _box(b"minf", sound, data, table))
        track = _full(b"tkhd", struct.pack(">QQIIQ" if wide else ">IIIII", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=version, flags=3)
        movie = _full(b"mvhd", struct.pack(span, 0, 0, RATE, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=version)
        return brand + _box(b"moov", movie, _box(b"trak", track, media))

    body = 16 if len(payload) + 8 >= 1 << 32 else 8
    size = len(head(0)) + body
    made = head(size)
    if len(made) + body != size:  # the far offsets' table is longer
        made = head(len(made) + body)
    return made + _box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box in ``data[start:end]`` as (path, body start, body end)."""
    while end - start >= 8:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("cut box")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if start + size > end or size < body - start:
            raise ValueError("box beyond its parent")
        yield (*path, kind), body, start + size
        if kind in NESTED:
            yield from boxes(data, body, start + size, (*path, kind))
        start += size


def _table(data: memoryview, at: int, end: int, kind: str, columns: int = 1) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at)
    width = np.dtype(kind).itemsize * columns
    if at + 4 + n * width > end:
        raise ValueError("cut table")
    return np.frombuffer(data, kind, n * columns, at + 4).astype(np.int64).reshape(n, columns)


def _track(data: memoryview, found: dict[bytes, tuple[int, int]]) -> Track:
    at, _ = found[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
    at, end = found[b"stsd"]
    codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
    if b"stsz" in found:
        at, end = found[b"stsz"]
        size, n = struct.unpack_from(">II", data, at + 4)
        if size and n > len(data):
            raise ValueError("more samples than bytes")
        sizes = np.full(n, size, np.int64) if size else _table(data, at + 8, end, ">u4")[:, 0]
    else:
        at, end = found[b"stz2"]
        width, n = struct.unpack_from(">II", data, at + 4)
        raw = np.frombuffer(data[at + 12 : end], np.uint8)
        if width == 4:
            sizes = np.stack([raw >> 4, raw & 15], axis=1).ravel()[:n].astype(np.int64)
        else:
            sizes = np.frombuffer(raw.tobytes(), ">u2" if width == 16 else ">u1", n).astype(np.int64)
    at, end = found[b"co64"] if b"co64" in found else found[b"stco"]
    chunks = _table(data, at + 4, end, ">u8" if b"co64" in found else ">u4")[:, 0]
    at, end = found[b"stsc"]
    runs = _table(data, at + 4, end, ">u4", 3)
    firsts = np.append(runs[:, 0] - 1, len(chunks))
    per_chunk = np.repeat(runs[:, 1], np.diff(firsts))
    if len(per_chunk) != len(chunks) or per_chunk.sum() != len(sizes):
        raise ValueError("sample tables disagree")
    before = np.cumsum(sizes) - sizes
    first_of_chunk = np.cumsum(per_chunk) - per_chunk
    offsets = before + np.repeat(chunks - before[np.minimum(first_of_chunk, len(before) - 1)], per_chunk) if len(sizes) else before
    if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("samples beyond the container")
    at, end = found[b"stts"]
    times = _table(data, at + 4, end, ">u4", 2)
    if times[:, 0].sum() != len(sizes):
        raise ValueError("time table disagrees")
    duration = duration or int((times[:, 0] * times[:, 1]).sum())
    keyframes = np.arange(len(sizes))
    if b"stss" in found:
        at, end = found[b"stss"]
        keyframes = _table(data, at + 4, end, ">u4")[:, 0] - 1
        if len(keyframes) and (keyframes.min() < 0 or keyframes.max() >= len(sizes)):
            raise ValueError("keyframe beyond the samples")
    return Track(codec, timescale, duration, offsets, sizes, keyframes)


def probe(media: bytes | None) -> Track | None:
    """The first track of a container, or None if it can't be read."""
    if not media:
        return None
    data, found = memoryview(media), {}
    try:
        for path, body, end in boxes(data, 0, len(data)):
            if path[:2] == (b"moov", b"trak"):
                if len(path) == 2 and found:
                    break  # the second track
                found[path[-1]] = (body, end)
        return _track(data, found)
    except (KeyError, ValueError, IndexError, struct.error):
        return None


def payload(media: bytes, track: Track) -> bytes:
    """The stored samples, in order, by the track's tables."""
    ends = track.offsets + track.sizes
    cuts = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    starts = track.offsets[np.r_[0, cuts]] if len(ends) else []
    stops = ends[np.r_[cuts - 1, len(ends) - 1]] if len(ends) else []
    return b"".join(media[a:b] for a, b in zip(starts, stops))


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                data = text.as_py()
                yield doc.as_py(), len(data), store(filled(data))

    return rows_out(STORED, rows(), lambda row: 64 + len(row[2]))


def media_column(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, media)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(_store_batches, "doc_id long, n_bytes long, media binary")


RANGE = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
PROBED = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", RANGE)]
    + [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
)


def _probe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for doc, size, column in zip(batch.column(0), batch.column(1), batch.column(2)):
                media = column.as_py()
                track = probe(media)
                known = (len(media), hashlib.sha256(media).hexdigest()) if media is not None else (None, None)
                if track is None:
                    yield (doc.as_py(), size.as_py(), *[None] * 8, *known)
                    continue
                stored = payload(media, track)
                ranges = [{"first": a, "end": b} for a, b in track.keyframe_ranges()]
                yield (doc.as_py(), size.as_py(), track.codec, track.timescale, track.duration, len(track.sizes), ranges, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-TAIL:]), *known)

    return rows_out(PROBED, rows(), lambda row: 400 + 16 * len(row[6] or ()))


def probed(media: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)`` -> what the containers hold, null if unreadable."""
    kinds = "doc_id long, n_bytes long, codec string, timescale long, duration long, n_samples long, keyframes array<struct<first:long,end:long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    return media.mapInArrow(_probe_batches, kinds)


def features(docs: DataFrame) -> DataFrame:
    """Store every text as a media column, read it back and describe it."""
    found = probed(media_column(docs))
    ranges = F.concat_ws(",", F.transform("keyframes", lambda x: F.concat_ws("-", x["first"].cast("string"), x["end"].cast("string"))))
    parts = [F.col("codec"), F.col("timescale").cast("string"), F.col("duration").cast("string"), F.col("n_samples").cast("string"), ranges]
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat_ws("|", *parts).alias("feature"), "codec", "duration", "keyframes")
