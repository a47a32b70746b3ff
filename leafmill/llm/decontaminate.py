"""Benchmark decontamination by latent semantic retrieval.

1. Frequencies of hashed words (features) over all passages of all documents.
2. A randomised SVD of the TF-IDF passages of all distinct texts, computed in tasks:
   a product of the matrix's Gram form with normal draws gives a basis, and the Gram
   form in that basis the directions; only sums of a fixed size come to the driver.
3. Every passage of every document (windows of a few words more than the item, one
   every eight words, or every eighth of long items) is projected and compared with every item by cosine.
   Places that hold the start of an item's answer, or any three words of an item
   of under 16, word for word are candidates too: there the cosine alone says little.
4. Candidates are checked on the words: a longest common subsequence of at least
   0.8 of the item, or of 0.6 if the item's answer (its last sentence) stands
   there word for word. Items of under five words have to stand there as they are.

Words are those between ASCII white space, A-Z lower-cased, ASCII punctuation
left out. Items are held in blocks of bounded size, so a benchmark of any length
works; a block needs one pass over the documents.

Defined cases: null and empty texts and items have no words and match nothing;
repeated rows give repeated results; a very long text is searched by one task, a
MB or the text at a time, about 100 bytes for each of its words; a null doc_id is reported as such, and so
is a null item_id: items are told apart by their rows, so those without id are searched like all others; an empty table of either kind gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, in_parts, rows_out, text_bytes, worker_keeps, written

FEATURE_BITS = 14
FEATURES = 1 << FEATURE_BITS
RANK = 96
EXTRA = 8
STEP = 8
PASSAGE = 48
#: Passages that a task of the SVD sums over, about (a task's sums have 14 MB); such tasks at least.
SUM_PASSAGES = 1 << 18
SUM_TASKS = 8
SUM_BLOCK = 512
#: Words whose passages meet a basis together, about, and the sums of its rows that are made at a time.
SUM_WORDS = PASSAGE << 14
SUM_ROWS = 256
DRAW = 5
#: Items compared in one pass.
ITEMS = 4096
COSINE = 0.55
SAME = 0.8
NEAR = 0.6
#: Items of fewer words match as they stand only; those of fewer than BRIEF are also looked for by their runs of SEED words.
FEWEST = 5
BRIEF = 16
SEED = 3
#: Words around a candidate window that the check also reads.
AROUND = 16

_PUNCTUATION = string.punctuation.encode()
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_MULTIPLY, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Bytes whose words are hashed together.
HASH_BLOCK = 1 << 20


def clean(data: bytes) -> bytes:
    """Lower case without punctuation, spaces only."""
    return data.lower().translate(_SPACES, _PUNCTUATION)


def words_of(data: bytes) -> list[bytes]:
    return clean(data).split()


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])


_up, _down = _powers(_MULTIPLY, HASH_BLOCK), _powers(_INVERSE, HASH_BLOCK)


def features_of(cleaned: bytes) -> np.ndarray:
    """The feature of each word: a polynomial hash of its bytes, all words at once."""
    out, start = [np.empty(0, np.int64)], 0
    while start < len(cleaned):
        end = len(cleaned)
        if end - start > HASH_BLOCK:
            end = cleaned.rfind(b" ", start, start + HASH_BLOCK)
            if end <= start:
                end = cleaned.find(b" ", start + HASH_BLOCK)
                end = len(cleaned) if end < 0 else end
        own = np.frombuffer(cleaned, np.uint8, end - start, start)
        n = len(own)
        up, down = (_up[:n], _down[:n]) if n <= HASH_BLOCK else (_powers(_MULTIPLY, n), _powers(_INVERSE, n))
        apart = np.flatnonzero(own == 32)
        begins, ends = np.zeros(len(apart) + 1, np.int64), np.full(len(apart) + 1, n)
        begins[1:], ends[:-1] = apart + 1, apart
        some = begins < ends
        begins, ends = begins[some], ends[some]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(own * up, out=sums[1:])
        codes = (sums[ends] - sums[begins]) * down[begins]
        codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(_MULTIPLY)
        out.append((codes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
        start = end + 1
    return np.concatenate(out)


# --- frequencies ---------------------------------------------------


def _hashed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_keeps("decontaminate")
    for batch in in_parts(batches):
        found = [features_of(clean(x.as_py())).astype(np.uint16).tobytes() for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["features", "copies"])


def hashed(texts: DataFrame) -> DataFrame:
    """``(features, copies)`` of texts, 16 bits for each word; a table that has them stays as it is."""
    if "features" in texts.columns:
        return texts
    copies = F.col("copies") if "copies" in texts.columns else F.lit(1)
    return texts.select(text_bytes(), copies.cast("long").alias("copies")).mapInArrow(_hashed_batches, "features binary, copies long")


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_keeps("decontaminate")
    total = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        for features, copies in zip(batch.column(0), batch.column(1).to_pylist()):
            found = np.frombuffer(features.as_py(), np.uint16).astype(np.int64)
            every = np.sort(np.arange(len(found)) // PASSAGE * FEATURES + found)
            every = every[np.r_[True, every[1:] != every[:-1]]] if len(every) else every
            np.add.at(total, every & (FEATURES - 1), copies)
            total[FEATURES] += copies * -(-len(found) // PASSAGE)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["feature", "n"])


def frequencies(docs: DataFrame) -> np.ndarray:
    """Passages with a word of each feature, and last the number of passages."""
    rows = hashed(docs).mapInArrow(_frequency_batches, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(FEATURES + 1, np.int64)
    for r in rows:  # at most FEATURES + 1
        total[r.feature] = r.n
    return total


def weights(n: np.ndarray) -> np.ndarray:
    """Inverse passage frequencies of the features."""
    return np.maximum(0.0, np.log((1 + n[FEATURES]) / (1 + n[:FEATURES])))


# --- randomised SVD ---------------------------------------------------------


def _passages(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The TF-IDF matrix of the texts' passages as (row, feature, value), rows of norm one."""
    rows, columns, base = [], [], 0
    for text in texts:
        found = features_of(clean(text))
        if len(found):
            rows.append(base + np.arange(len(found)) // PASSAGE)
            columns.append(found)
            base = int(rows[-1][-1]) + 1
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    keys, n = np.unique(np.concatenate(rows) * FEATURES + np.concatenate(columns), return_counts=True)
    row, column = keys // FEATURES, keys % FEATURES
    value = n * idf[column]
    norm = np.sqrt(np.bincount(row, value * value))
    return row, column, value / np.maximum(norm[row], 1e-12)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The features of texts with words, about ``SUM_WORDS`` at a time."""
    held, size = [], 0
    for batch in batches:
        for x in batch.column(0):
            found = np.frombuffer(x.as_py(), np.uint16).astype(np.int64)
            for at in range(0, len(found), SUM_WORDS):  # whole passages
                held.append(found[at : at + SUM_WORDS])
                size += len(held[-1])
                if size >= SUM_WORDS:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _sums(table: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The sums of the table's rows that each step names, and a row of zeros."""
    out = np.empty((len(steps) + 1, table.shape[1]), table.dtype)
    out[-1] = 0
    held = np.empty((SUM_ROWS, table.shape[1]), table.dtype)
    nth = np.ascontiguousarray(steps.T)
    for at in range(0, len(steps), SUM_ROWS):  # stays in the cache
        own = out[at : min(at + SUM_ROWS, len(steps))]
        part = held[: len(own)]
        table.take(nth[0, at : at + SUM_ROWS], axis=0, out=own, mode="clip")
        for k in range(1, STEP):
            table.take(nth[k, at : at + SUM_ROWS], axis=0, out=part, mode="clip")
            own += part
    return out


def _padded(values: np.ndarray, sizes: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values as whole steps, filled up with ``none``, and the steps of each run."""
    steps = -(-sizes // STEP)
    shift = (np.cumsum(steps) - steps) * STEP - (np.cumsum(sizes) - sizes)
    out = np.full(int(steps.sum()) * STEP, none)
    out[np.arange(len(values)) + np.repeat(shift, sizes)] = values
    return out.reshape(-1, STEP), steps


def _run_sums(table: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run's rows of the table, whose last row is zero; steps are added up by steps once."""
    steps, own = _padded(values, sizes, len(table) - 1)
    sums = _sums(table, steps)
    if own.max() > 1:
        steps, own = _padded(np.arange(len(steps)), own, len(steps))
        sums = _sums(sums, steps)
    return np.add.reduceat(sums[:-1], np.cumsum(own) - own, axis=0) if own.max() > 1 else sums[:-1]


def _projected(texts: list[np.ndarray], idf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, passage of each, norms of the passages, passages of norm one times the basis).

    ``table`` is the basis times the frequencies, and a row of zeros: a passage is the sum of its words' rows.
    """
    sizes = np.array([len(x) for x in texts])
    words, passages = np.concatenate(texts), -(-sizes // PASSAGE)
    within = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.cumsum(passages) - passages, sizes) + within // PASSAGE
    keys = np.sort(row * FEATURES + words)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    value = np.diff(np.r_[at, len(keys)]) * idf[keys[at] & (FEATURES - 1)]
    norm = np.maximum(np.sqrt(np.bincount(keys[at] // FEATURES, value * value)), 1e-12)
    projected = _run_sums(table, words, np.bincount(row))
    projected /= norm.astype(table.dtype)[:, None]
    return words, row, norm, projected


def _with_zeros(rows: np.ndarray) -> np.ndarray:
    return np.vstack([rows, np.zeros((1, rows.shape[1]), rows.dtype)])


def _range_batches(batches: Iterator[pa.RecordBatch], idf: np.ndarray, kind: type) -> Iterator[pa.RecordBatch]:
    """The task's share of A'A times normal draws, in blocks of features; every task makes the same draws."""
    worker_keeps("decontaminate")
    table = _with_zeros(idf[:, None] * np.random.default_rng(DRAW).normal(size=(FEATURES, RANK + EXTRA))).astype(kind)
    total = np.zeros((FEATURES, RANK + EXTRA))
    some = False
    for texts in _gathered(batches):
        some = True
        words, row, norm, projected = _projected(texts, idf, table)
        # the passages that have each feature, as often as they have it
        n = np.bincount(words, minlength=FEATURES)
        held = np.flatnonzero(n)
        projected /= norm.astype(kind)[:, None]
        total[held] += _run_sums(_with_zeros(projected), row[np.argsort(words.astype(np.uint16), kind="stable")], n[held])
    if some:
        total *= idf[:, None]
        blocks = range(0, FEATURES, SUM_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([total[b : b + SUM_BLOCK].tobytes() for b in blocks])], ["block", "sums"])


def _summed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's sum, a batch at a time."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(sums.as_py())
            total[block] = total[block] + own if block in total else own
    for block, sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sums.tobytes()])], ["block", "sums"])


def _inner_batches(batches: Iterator[pa.RecordBatch], idf: np.ndarray, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The task's share of (A basis)'(A basis), a small matrix."""
    worker_keeps("decontaminate")
    table = _with_zeros(idf[:, None] * basis).astype(basis.dtype)
    total = np.zeros((basis.shape[1], basis.shape[1]))
    for texts in _gathered(batches):
        *_, projected = _projected(texts, idf, table)
        total += projected.T @ projected
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([total.tobytes()])], ["block", "sums"])


def _basis(texts: DataFrame, idf: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """An orthonormal basis of what the passages' Gram form makes of normal draws; a passage's sums are of ``kind``."""
    tasks = hashed(texts).mapInArrow(lambda batches: _range_batches(batches, idf, kind), "block long, sums binary")
    parts = tasks.repartition("block").mapInArrow(_summed_batches, "block long, sums binary").collect()
    out = np.zeros((FEATURES, RANK + EXTRA))
    while parts:  # FEATURES / SUM_BLOCK rows
        r = parts.pop()
        found = np.frombuffer(r.sums).reshape(-1, RANK + EXTRA)
        out[r.block : r.block + len(found)] = found
    return np.linalg.qr(out)[0]


def _inner(texts: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The Gram form in the basis, (A basis)'(A basis)."""
    shared = texts.sparkSession.sparkContext.broadcast((idf, basis))
    tasks = hashed(texts).mapInArrow(lambda batches: _inner_batches(batches, *shared.value), "block long, sums binary")
    parts = tasks.repartition("block").mapInArrow(_summed_batches, "block long, sums binary").collect()  # one row
    shared.destroy()
    return sum((np.frombuffer(r.sums) for r in parts), np.zeros(basis.shape[1] ** 2)).reshape(basis.shape[1], -1)


def projection(docs: DataFrame) -> np.ndarray:
    """(FEATURES + 1, RANK): a word's weight in each whitened latent direction.

    Words are hashed once for each distinct text; copies count in the frequencies, not in the directions.
    """
    distinct = docs.select(text_bytes()).groupBy("text").agg(F.count("*").alias("copies"))
    held, path = written(hashed(distinct), "features")
    n = frequencies(held)
    idf = weights(n)
    # read in tasks of as many passages, as each task has sums of its own
    held = held.coalesce(max(SUM_TASKS, -(-int(n[FEATURES]) // SUM_PASSAGES)))
    basis = _basis(held, idf, np.float32)
    inner = _inner(held, idf, basis.astype(np.float32))
    drop(docs.sparkSession, path)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-values)[:RANK]
    spread = np.sqrt(np.maximum(values[best], 1e-9 * max(float(values.max()), 1e-9)))
    out = np.zeros((FEATURES + 1, RANK), np.float32)
    out[:FEATURES] = idf[:, None] * (basis @ vectors[:, best]) / spread
    return out


# --- search -----------------------------------------------------------------


def size_unit(n: int) -> int:
    """About an eighth of n words, a power of two, at least ``STEP``."""
    return max(STEP, 1 << max(0, (n - 1).bit_length() - 3))


def size_class(n: int) -> int:
    """The words of the windows that n words are looked for in: a few more than n."""
    unit = size_unit(n)
    return max(2 * STEP, -(-n // unit) * unit)


def places_of(words: list[bytes]) -> dict[bytes, int]:
    """A bit vector of each word's places."""
    places: dict[bytes, int] = {}
    for k, word in enumerate(words):
        places[word] = places.get(word, 0) | 1 << k
    return places


def common_length(size: int, places: dict[bytes, int], words: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit vectors over the first."""
    full = row = (1 << size) - 1
    for word in words:
        hit = places.get(word)
        if hit:
            hit &= row
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def answer_of(data: bytes) -> list[bytes]:
    """The words of the last sentence, or the last quarter if it is very short."""
    parts = [w for w in (words_of(p) for p in re.split(rb"[.!?\n]+", data)) if w]
    last = parts[-1] if parts else []
    words = words_of(data)
    return last if len(last) >= 3 else words[-max(1, len(words) // 4) :]


def seed_keys(features: np.ndarray) -> np.ndarray:
    """A key of each run of ``SEED`` words."""
    return sum(features[k : len(features) - SEED + 1 + k] << FEATURE_BITS * k for k in range(SEED))


@dataclass
class Items:
    """A block of benchmark items, projected."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    table: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.places = [places_of(words) for words in self.words]
        self.counts = [{w: x.bit_count() for w, x in own.items()} for own in self.places]
        by: dict[int, list[int]] = {}
        self.exact: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        seeds: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            if len(words) < FEWEST:
                if words:
                    self.exact.setdefault(len(words), {}).setdefault(tuple(words), []).append(k)
                continue
            by.setdefault(size_class(len(words)), []).append(k)
            places = range(len(words) - SEED + 1) if len(words) < BRIEF else ()
            if not places and len(self.answers[k]) >= SEED:
                starts = [i for i in range(len(words)) if words[i : i + len(self.answers[k])] == self.answers[k]]
                places = starts[-1:]
            for i in places:
                key = int(seed_keys(features_of(b" ".join(words[i : i + SEED])))[0])
                seeds.setdefault(key, []).append((k, i))
        self.seeds = [own for _, own in sorted(seeds.items())]
        self.seed_keys = np.array(sorted(seeds), np.int64)
        self.seed_filter = np.zeros(1 << 16, bool)
        self.seed_filter[self.seed_keys * 40503 & 0xFFFF] = True
        for size, own in by.items():
            sums = np.stack([self.table[features_of(b" ".join(self.words[k]))].sum(axis=0) for k in own])
            self.classes[size] = (np.array(own), (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).T.astype(np.float32))

    def seeded(self, found: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, first word) of each place that holds a seed, by a text's features."""
        if len(found) < SEED or not len(self.seed_keys):
            return
        keys = seed_keys(found)
        some = np.flatnonzero(self.seed_filter[keys * 40503 & 0xFFFF])
        at = np.minimum(np.searchsorted(self.seed_keys, keys[some]), len(self.seed_keys) - 1)
        hit = self.seed_keys[at] == keys[some]
        for place, k in zip(some[hit].tolist(), at[hit].tolist()):
            for item, offset in self.seeds[k]:
                yield item, place - offset

    def candidates(self, cleaned: list[bytes]) -> dict[tuple[int, int], list[tuple[int, int, float]]]:
        """(document, item) -> (first word, words, cosine) of windows alike."""
        out: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        starts, parts, at = [], [], 0
        room = max(map(size_unit, self.classes), default=STEP)
        for k, own in enumerate(cleaned):
            starts.append(at)
            found = features_of(own)
            for item, place in self.seeded(found):
                out.setdefault((k, item), []).append((max(0, place), len(self.words[item]), -1.0))
            parts += [found, np.full(-len(found) % room, FEATURES)]
            at += -(-len(found) // room) * (room // STEP)
        longest = max(self.classes, default=STEP)
        parts.append(np.full(longest + room, FEATURES))
        steps = np.concatenate(parts).reshape(-1, STEP)
        sums = _sums(self.table, steps)
        first = np.array(starts)
        for begin in range(0, at, 2048):
            end = min(at, begin + 2048)
            last = 0
            for size, (own, items) in sorted(self.classes.items()):
                if last != size_unit(size):  # windows of one unit grow from class to class
                    last, every, held = size_unit(size), size_unit(size) // STEP, 1
                    windows = sums[begin:end:every].copy()
                for k in range(held, size // STEP):
                    windows += sums[begin + k : end + k : every]
                held = size // STEP
                norms = np.sqrt(np.einsum("ij,ij->i", windows, windows))
                alike = windows @ items
                rows, columns = np.nonzero(alike >= COSINE * np.maximum(norms, 1e-6)[:, None])
                blocks = begin + every * rows
                docs = np.searchsorted(first, blocks, side="right") - 1
                for row, column, block, doc in zip(rows.tolist(), columns.tolist(), blocks.tolist(), docs.tolist()):
                    place = ((block - starts[doc]) * STEP, size, float(alike[row, column] / norms[row]))
                    out.setdefault((doc, int(own[column])), []).append(place)
        return out

    def checked(self, item: int, words: list[bytes], places: list[tuple[int, int, float]]) -> tuple[float, bool, int] | None:
        """(share in common, answer there, first word) of the best place that matches."""
        wanted, answer, held = self.words[item], self.answers[item], self.places[item]
        best = None
        reach = -1
        for first, size, _ in sorted(places):
            begin, end = max(0, first - AROUND), min(len(words), first + size + AROUND)
            if end <= reach:
                continue
            reach = end
            region = words[begin:end]
            if sum(map(self.counts[item].__getitem__, held.keys() - set(region))) > (1 - NEAR) * len(wanted):
                continue  # too many of its words are missing
            share = common_length(len(wanted), held, region) / len(wanted)
            if share < NEAR:
                continue
            told = b" " + b" ".join(answer) + b" " in b" " + b" ".join(region) + b" "
            if (share >= SAME or told) and (best is None or share > best[0]):
                best = (share, told, begin)
        return best

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, float, float, bool, int]]:
        """(document, item, cosine, share, answer, first word) of every match."""
        cleaned = [clean(t) for t in texts]
        last, words = -1, []
        for (doc, item), places in sorted(self.candidates(cleaned).items()):
            if doc != last:
                last, words = doc, cleaned[doc].split()
            found = self.checked(item, words, places)
            if found:
                cosine = max(p[2] for p in places)
                yield doc, item, cosine if cosine >= 0 else self.cosine(item, words[found[2] :]), *found
        for doc, own in enumerate(cleaned if self.exact else ()):
            words = own.split()
            for n, wanted in self.exact.items():
                met = {}
                for place, run in enumerate(zip(*(words[k:] for k in range(n)))):
                    for item in wanted.get(run, ()):
                        met.setdefault(item, place)
                for item, place in met.items():
                    yield doc, item, 1.0, 1.0, True, place

    def cosine(self, item: int, words: list[bytes]) -> float:
        """Of an item and as many words."""
        one, two = (self.table[features_of(b" ".join(x))].sum(axis=0) for x in (self.words[item], words[: len(self.words[item])]))
        return float(one @ two / max(1e-9, float(np.linalg.norm(one) * np.linalg.norm(two))))


def blocks(benchmark: DataFrame, table: np.ndarray, size: int = ITEMS) -> Iterator[Items]:
    """The benchmark's items, a bounded number at a time."""
    held: list[tuple[int | None, bytes]] = []

    def made() -> Items:
        return Items([x for x, _ in held], [words_of(t) for _, t in held], [answer_of(t) for _, t in held], table)

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_bytes()).toLocalIterator()
    for r in rows:
        held.append((r.item_id, bytes(r.text)))
        if len(held) == size:
            yield made()
            held = []
    if held:
        yield made()


def _grouped(texts: Iterator[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.bool_()), ("first_word", pa.int64())])
FOUND_DDL = "doc_id long, item_id long, cosine double, common double, answer boolean, first_word long"


def _search_batches(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    worker_keeps("decontaminate")

    def rows():
        for batch in in_parts(batches):
            docs = batch.column(0).to_pylist()
            base = 0
            for texts in _grouped(x.as_py() for x in batch.column(1)):
                for doc, item, cosine, share, told, first in items.search(texts):
                    yield docs[base + doc], items.ids[item], round(cosine, 4), round(share, 4), told, first
                base += len(texts)

    return rows_out(FOUND, rows())


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    spark = docs.sparkSession
    table = projection(docs)
    found = spark.createDataFrame([], FOUND_DDL)
    for items in blocks(benchmark, table):
        shared = spark.sparkContext.broadcast(items)
        asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
        found = found.unionByName(asked.mapInArrow(lambda batches, shared=shared: _search_batches(batches, shared.value), FOUND_DDL))
    return found


def _clean_batches(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    worker_keeps("decontaminate")
    for batch in in_parts(batches):
        texts = [(x.as_py() or "").encode() for x in batch.column("text")]
        keep = np.ones(len(texts), bool)
        base = 0
        for own in _grouped(iter(texts)):
            keep[[base + hit[0] for hit in items.search(own)]] = False
            base += len(own)
        yield batch.filter(pa.array(keep))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, as they are."""
    spark = docs.sparkSession
    table = projection(docs)
    for items in blocks(benchmark, table):
        shared = spark.sparkContext.broadcast(items)
        docs = docs.mapInArrow(lambda batches, shared=shared: _clean_batches(batches, shared.value), docs.schema)
    return docs
