"""SentencePiece encoding and decoding by suffix-array matching.

A batch's unmet text is concatenated, its suffixes are sorted, and every piece of
the model is found by binary search as a range of suffixes: each suffix in the
range is an edge of the text's lattice. Edges are sorted by position and relaxed
from left to right, at each position the longest first, all units of a batch
in step.

The model at hand merges pairs (BPE), so an edge relaxes its end only if the
piece may follow the piece that the start was reached by: that is, if merging the
two pieces' characters by score gives back those two. At most one edge does so at
each position, so a position that leads nowhere is not tried again, and the path
to the end is the merge result, which makes the ids equal to the sentencepiece
library's. Characters that no piece holds are written
as byte pieces.

A word, of whatever length, is matched once while a worker remembers it. A unit of
over ``LONG`` characters, as in scripts without spaces, is cut wherever no piece
holds the two characters side by side: no merge crosses such a place. What stays
uncut, such as one letter repeated a million times, takes some 100 bytes of memory
for each of its bytes.

Defined cases: a null or empty text has no pieces and decodes to the empty text;
U+2581 in a text decodes to a space, as the model writes spaces with it; unknown
ids decode to nothing; rows are independent, so ties, repeats, null ids and other
columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_out, text_bytes, together, worker_keeps
from .lookup import Lookup, gathered

SPACE = "▁"
#: Bytes of unmet text that are indexed at a time.
INDEX_BYTES = 3 << 16
#: Units of text that a worker remembers in each generation; slots for pairs of pieces, as a power of two.
REMEMBER = 1_000_000
PAIR_BITS = 21
#: Characters over which a unit is cut where no piece can stand across.
LONG = 256
#: Texts that hold one of these are cut to units by pattern.
UNEVEN = ["\0", "  ", SPACE]
#: Bytes of text that are encoded together, ids that are decoded together.
TOGETHER = 2 << 20
GATHER = 1 << 19


class Model:
    """Pieces with scores, and the byte pieces, as plain lists that can be shipped."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.texts: list[str] = [model.id_to_piece(k) for k in range(size)]
        self.bytes_of: dict[int, int] = {}
        self.scores: dict[str, tuple[int, float]] = {}
        for k, text in enumerate(self.texts):
            if model.is_byte(k):
                self.bytes_of[k] = int(text[3:5], 16)
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.scores[text] = (k, model.get_score(k))
        if len(self.bytes_of) != 256:
            raise ValueError("the model has no byte pieces")


class Pairs:
    """Which pieces may follow which, by open addressing; emptied when half full."""

    def __init__(self, bits: int = PAIR_BITS):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys, self.good, self.held = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, bool), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(good, unknown) of each key."""
        slots, left = self._slots(keys), np.arange(len(keys))
        good, unknown = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        while len(left):
            met = self.keys[slots[left]]
            hit = met == keys[left]
            good[left[hit]] = self.good[slots[left[hit]]]
            unknown[left[met < 0]] = True
            left = left[~hit & (met >= 0)]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
        return good, unknown

    def add(self, keys: np.ndarray, good: np.ndarray) -> None:
        """Distinct keys that are not held."""
        most = 1 << self.bits - 1
        if self.held + len(keys) > most:
            self.clear()
        for key, slot, value in zip(keys[:most].tolist(), self._slots(keys[:most]).tolist(), good[:most].tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.good[slot] = key, value
        self.held += len(keys[:most])


class Encoder:
    def __init__(self, model: Model):
        self.scores = model.scores
        self.texts = model.texts
        self.byte_ids = [k for k, _ in sorted(model.bytes_of.items(), key=lambda x: x[1])]
        self.letters = set("".join(self.scores))
        self.breaks = "".join(c for c in "\n\t\r" if c not in self.letters)
        self.cut = not any(SPACE in text.lstrip(SPACE) for text in self.scores)
        breaks = self.breaks
        if not self.cut:
            self.units = re.compile("(?s).+").findall
        elif breaks:
            self.units = re.compile(f"{SPACE}+[^{SPACE}{breaks}]*|[^{SPACE}{breaks}]+|[{breaks}]").findall
        else:
            self.units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        coded = sorted((text.encode(), k) for text, (k, _) in self.scores.items())
        self.width = max(len(x) for x, _ in coded) + 1
        self.piece_ids = np.array([k for _, k in coded])
        self.piece_sizes = np.array([len(x) for x, _ in coded])
        self.low = np.array([x for x, _ in coded], f"S{self.width}")
        self.high = np.array([x + b"\xff" for x, _ in coded], f"S{self.width}")
        self.kind = np.dtype("<u2" if len(self.texts) <= 1 << 16 else "<u4")
        self.known = Lookup(self.kind, self._learn, REMEMBER)
        self.pairs = Pairs()
        self.joins: set[str] | None = None

    def merged(self, text: str) -> list[str]:
        """Merge the best adjacent pair, the leftmost of equals, until none is left."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = scores.get(parts[k] + parts[k + 1])
                if found and (best is None or found[1] > best):
                    best, at = found[1], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: int, piece: int) -> bool:
        """Whether merging the characters of both pieces gives back the two."""
        if before < 0:
            return self.merged(self.texts[piece]) == [self.texts[piece]]
        a, b = self.texts[before], self.texts[piece]
        return a + b not in self.scores and self.merged(a + b) == [a, b]

    def may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``follows`` of many pairs; each pair is judged once."""
        keys = (before + 1) << 24 | piece
        good, unknown = self.pairs.find(keys)
        if unknown.any():
            fresh, own = np.unique(keys[unknown], return_inverse=True)
            told = np.array([self.follows((key >> 24) - 1, key & 0xFFFFFF) for key in fresh.tolist()])
            good[unknown] = told[own]
            self.pairs.add(fresh, told)
        return good

    def edges(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, piece) of every occurrence in ``data``, sorted by position."""
        room = np.frombuffer(data + bytes(self.width), np.uint8)
        starts = np.flatnonzero((room[: len(data)] & 0xC0 != 0x80) & (room[: len(data)] != 0))
        windows = np.lib.stride_tricks.sliding_window_view(room, self.width)[starts]
        suffixes = np.ascontiguousarray(windows).view(f"S{self.width}").ravel()
        order = np.argsort(suffixes, kind="stable")
        ranked = suffixes[order]
        first = np.searchsorted(ranked, self.low)
        counts = np.searchsorted(ranked, self.high) - first
        held = np.flatnonzero(counts)
        counts = counts[held]
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = starts[order[np.repeat(first[held], counts) + inside]]
        size, piece = np.repeat(self.piece_sizes[held], counts), np.repeat(self.piece_ids[held], counts)
        by_place = np.sort((at << 32) | (size << 24) | piece)
        return by_place >> 32, by_place >> 24 & 0xFF, by_place & 0xFFFFFF

    def relaxed(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each unit has); units hold known characters only.

        All units step together, each from its own place: forward by an edge that
        may follow, to the next shorter edge where one may not, and back where a
        place leads nowhere. ``came`` holds the edge that reached each place.
        """
        coded = [u.encode() for u in units]
        at, size, piece = self.edges(b"\0".join(coded))
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        stop = np.cumsum(sizes + 1) - 1
        base = stop - sizes
        first = np.searchsorted(at, np.arange(int(stop[-1]) + 2))
        end, place = at + size, base.copy()
        dead, came = np.zeros(int(stop[-1]) + 1, bool), np.zeros(int(stop[-1]) + 1, np.int64)
        last, edge = np.full(len(coded), -1), first[place + 1] - 1
        left = np.arange(len(coded))
        while len(left):
            stuck = edge[left] < first[place[left]]
            if stuck.any():
                back, left = left[stuck], left[~stuck]
                if (place[back] == base[back]).any():
                    raise ValueError("no path through a unit")
                dead[place[back]] = True
                edge[back] = came[place[back]]
                place[back] = at[edge[back]]
                last[back] = np.where(place[back] == base[back], -1, piece[came[place[back]]])
                edge[back] -= 1
            else:
                back = left[:0]
            own = edge[left]
            good = ~dead[end[own]]
            good[good] = self.may_follow(last[left[good]], piece[own[good]])
            edge[left[~good]] -= 1
            moved, own = left[good], own[good]
            place[moved], last[moved], came[end[own]] = end[own], piece[own], own
            edge[moved] = first[place[moved] + 1] - 1
            left = np.concatenate([left[place[left] < stop[left]], back])
        left, taken = np.arange(len(coded)), []
        while len(left):  # the paths, from their ends
            own = came[place[left]]
            taken.append((left, piece[own]))
            place[left] = at[own]
            left = left[place[left] > base[left]]
        unit, ids = (np.concatenate(x) for x in zip(*reversed(taken)))
        order = np.argsort(unit, kind="stable")
        return ids[order].astype(self.kind), np.bincount(unit, minlength=len(coded))

    def _pieced(self, part: str) -> list[str]:
        """A long part, cut wherever no piece holds the two characters side by side."""
        if len(part) <= LONG:
            return [part] if part else []
        if self.joins is None:
            self.joins = {x[k : k + 2] for x in self.scores for k in range(len(x) - 1)}
        cuts = [k for k in range(1, len(part)) if part[k - 1 : k + 1] not in self.joins]
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])]

    def _blocks(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, start = [], 0
        while start < len(units):
            end, size = start, 0
            while end < len(units) and (end == start or size < INDEX_BYTES):
                size += len(units[end])
                end += 1
            found.append(self.relaxed(units[start:end]))
            start = end
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, self.kind), np.empty(0, np.int64))

    def _learn(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.letters.issuperset("".join(fresh)) and max(map(len, fresh)) <= LONG:
            return self._blocks(fresh)
        parts, counts = [], []  # runs of characters that pieces hold, and single others
        for unit in fresh:
            own = [""]
            if self.letters.issuperset(unit):
                own[0] = unit
            else:
                for c in unit:
                    if c in self.letters:
                        own[-1] += c
                    else:
                        own += [c, ""]
            own = [x for own_part in own for x in self._pieced(own_part)]
            parts += own
            counts.append(len(own))
        ids, n = self._blocks([x for x in parts if x[0] in self.letters])
        ends, at, out, sizes = np.cumsum(n), 0, [], []
        for x in parts:
            if x[0] in self.letters:
                out.append(ids[ends[at] - n[at] : ends[at]])
                at += 1
            else:
                out.append(np.array([self.byte_ids[b] for b in x.encode("utf-8", "surrogatepass")], self.kind))
            sizes.append(len(out[-1]))
        totals = np.r_[0, np.cumsum(sizes)]
        stops = np.cumsum(counts)
        return np.concatenate(out), totals[stops] - totals[stops - np.array(counts)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many of them each text has)."""
        even, uneven = [], []
        for k, text in enumerate(texts):
            plain = self.cut and text and text[0] != " " and not any(x in text for x in UNEVEN)
            (even if plain else uneven).append(k)
        counts = np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = [np.empty(0, self.kind)] * len(texts)
        for some, make in ((even, self._even), (uneven, self._cut)):
            if some:
                ids, own = make([texts[k] for k in some])
                counts[some] = own
                for k, part in zip(some, np.split(ids, np.cumsum(own)[:-1])):
                    held[k] = part
        return np.concatenate(held), counts

    def _even(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose words stand apart by single spaces or by breaks."""
        marked = [SPACE + t.replace(" ", "\0" + SPACE) for t in texts]
        for c in self.breaks:
            marked = [t.replace(c, f"\0{c}\0") for t in marked]
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), "\0")
        return self.known.joined(lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64))

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        units = [self.units(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        return self.known.joined(pa.array([x for own in units for x in own], pa.large_string()), np.fromiter(map(len, units), np.int64, len(units)))


class Decoder:
    def __init__(self, model: Model):
        table = [b""] * len(model.texts)
        for text, (k, _) in model.scores.items():
            table[k] = text.replace(SPACE, " ").encode()
        for k, byte in model.bytes_of.items():
            table[k] = bytes([byte])
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = np.array([*map(len, table), 0], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        """The bytes of each text, of ``counts`` ids, without the space that encoding put first."""
        own = np.where((ids >= 0) & (ids < len(self.sizes)), ids, len(self.sizes) - 1)
        held = memoryview(gathered(self.flat, self.starts[own], self.sizes[own]).tobytes())
        ends = np.r_[0, np.cumsum(self.sizes[own])]
        stops = np.cumsum(counts)
        for a, b in zip(ends[stops - counts].tolist(), ends[stops].tolist()):
            yield bytes(held[a + 1 : b]) if held[a : a + 1] == b" " and a < b else bytes(held[a:b])


def _once(kind: str, model: Model, make):
    """One encoder or decoder for each worker and model."""
    kept = worker_keeps("pieces")
    if kind not in kept or kept[kind][0] is not model:
        kept[kind] = (model, make(model))
    return kept[kind][1]


def _encode_batches(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("ids", pa.list_(pa.int32()))])
    for docs, raw in together(batches, TOGETHER):
        coded, counts = encoder([x.decode("utf-8", "replace") for x in raw])
        ids = pa.array(coded.astype(np.int32))
        offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        columns = [pa.array(docs, pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.ListArray.from_arrays(offsets, ids)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, text_sha256, ids)``.

    The driver reads the model's file (fixed, under 1 MB) and ships its pieces.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encode_batches(batches, _once("encoder", shared.value, Encoder))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, "doc_id long, n_bytes long, text_sha256 string, ids array<int>")


DECODED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("text_sha256", pa.string()), ("decoded_sha256", pa.string())])
DECODED_DDL = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, text_sha256 string, decoded_sha256 string"


def _decode_batches(batches: Iterator[pa.RecordBatch], decoder: Decoder, whole: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*DECODED, ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]) if whole else DECODED

    def rows():
        for batch in batches:
            at, lists = 0, batch.column(3)
            while at < len(batch):  # a bounded number of ids at a time, a row at least
                some = lists.slice(at)
                counts = pc.fill_null(pc.list_value_length(some), 0).to_numpy().astype(np.int64)
                n = max(1, int(np.searchsorted(np.cumsum(counts), GATHER)))
                part, counts = batch.slice(at, n), counts[:n]
                values = part.column(3).flatten().to_numpy()
                columns = [part.column(k).to_pylist() for k in range(3)]
                for doc, size, sha, own, found in zip(*columns, np.split(values, np.cumsum(counts)[:-1]), decoder(values, counts)):
                    row = doc, size, len(own), zlib.crc32(own.astype("<u4").tobytes()), sha, hashlib.sha256(found).hexdigest()
                    yield (*row, own, found.decode("utf-8", "replace")) if whole else row
                at += n

    return rows_out(schema, rows(), lambda row: 200 + (4 * len(row[6]) + len(row[7]) if whole else 0))


def decoded(ids: DataFrame, path: str, whole: bool = True) -> DataFrame:
    """What ``encoded`` gives -> counts, checksums and (whole) the ids and the text."""
    shared = ids.sparkSession.sparkContext.broadcast(Model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decode_batches(batches, _once("decoder", shared.value, Decoder), whole)

    return ids.select("doc_id", "n_bytes", "text_sha256", "ids").mapInArrow(run, DECODED_DDL + (", ids array<int>, decoded string" if whole else ""))


def encoded_and_decoded(docs: DataFrame, path: str, whole: bool = True) -> DataFrame:
    """``decoded(encoded(docs))`` in one pass through the same Python workers."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = _encode_batches(batches, _once("encoder", shared.value, Encoder))
        return _decode_batches(coded, _once("decoder", shared.value, Decoder), whole)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, DECODED_DDL + (", ids array<int>, decoded string" if whole else ""))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every whole text, decode its ids and compare the digests."""
    found = encoded_and_decoded(docs, path, whole=False)
    return found.select("doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_sha256", (F.col("text_sha256") == F.col("decoded_sha256")).alias("same"))
