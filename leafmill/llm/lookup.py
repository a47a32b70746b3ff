"""Ids of words met before, kept by hash in sorted arrays of bounded size.

Words come as the distinct values of an Arrow column. A word of at most ``SHORT``
bytes is known by two independent 64-bit hashes of its bytes; longer ones are
learned anew each time. Two generations of at most ``limit`` words are kept: when
the young one is full it becomes the old one, and old words that are met again
move to the young one. A word takes about 20 bytes and its ids, against some 200
in a dictionary.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

SHORT = 64
_FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def spans(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes) of a string column without nulls."""
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    _, offsets, data = words.buffers()
    held = np.frombuffer(offsets, kind, len(words) + 1, words.offset * np.dtype(kind).itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), held[:-1], np.diff(held)


def hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word's first ``SHORT`` bytes and size, and the sizes."""
    data, starts, sizes = spans(words)
    one, two = sizes.astype(np.uint64) + np.uint64(1), sizes.astype(np.uint64) + np.uint64(7)
    left = np.arange(len(sizes))
    for k in range(min(SHORT, int(sizes.max(initial=0)))):
        left = left[sizes[left] > k]
        byte = data[starts[left] + k].astype(np.uint64) + np.uint64(1)
        for held, factor in zip((one, two), _FACTORS):
            fed = (held[left] ^ byte) * factor
            held[left] = fed ^ (fed >> _SHIFT)
    return one, two, sizes


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches ``flat[start : start + size]``, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]


class _Level:
    """Words sorted by their first hash."""

    def __init__(self, kind: np.dtype):
        self.one = self.two = np.empty(0, np.uint64)
        self.starts, self.sizes, self.flat = np.empty(0, np.int32), np.empty(0, np.uint16), np.empty(0, kind)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The row of each word, -1 where it is unknown; ``one`` is sorted."""
        if not len(self.one):
            return np.full(len(one), -1)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return np.where((self.one[at] == one) & (self.two[at] == two), at, -1)

    def add(self, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Words whose ids stand one after the other in ``flat``."""
        starts = np.cumsum(sizes) - sizes + len(self.flat)
        self.flat = np.concatenate([self.flat, flat])
        own = np.argsort(one)
        one = np.concatenate([self.one, one[own]])
        order = np.argsort(one, kind="stable")  # merges two sorted runs
        self.one = one[order]
        self.two = np.concatenate([self.two, two[own]])[order]
        self.starts = np.concatenate([self.starts, starts[own].astype(np.int32)])[order]
        self.sizes = np.concatenate([self.sizes, sizes[own].astype(np.uint16)])[order]


class Lookup:
    """``learn`` gives (ids, number of ids of each word) of words that are not known."""

    def __init__(self, kind: np.dtype, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.kind, self.learn, self.limit = np.dtype(kind), learn, limit
        self.young, self.old = _Level(self.kind), _Level(self.kind)

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, sizes) of the ids of distinct words; an empty word has none."""
        one, two, bytes_of = hashes(words)
        ranked = np.argsort(one)
        rows, before = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
        for level, held in ((self.young, rows), (self.old, before)):
            held[ranked] = level.find(one[ranked], two[ranked])
        filled = bytes_of > 0
        rows[bytes_of > SHORT] = before[bytes_of > SHORT] = -1
        known, again = np.flatnonzero(filled & (rows >= 0)), np.flatnonzero(filled & (rows < 0) & (before >= 0))
        fresh = np.flatnonzero(filled & (rows < 0) & (before < 0))
        ids, n_ids = self.learn(words.take(pa.array(fresh)).to_pylist()) if len(fresh) else (np.empty(0, self.kind), np.empty(0, np.int64))
        order = np.concatenate([known, again, fresh])
        parts = [(self.young, rows[known]), (self.old, before[again])]
        sizes = np.concatenate([level.sizes[own].astype(np.int64) for level, own in parts] + [n_ids])
        flat = np.concatenate([gathered(level.flat, level.starts[own].astype(np.int64), level.sizes[own].astype(np.int64)) for level, own in parts] + [ids])
        all_starts, all_sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        all_starts[order], all_sizes[order] = np.cumsum(sizes) - sizes, sizes
        late = np.concatenate([again, fresh])
        late = late[bytes_of[late] <= SHORT]
        if len(self.young.one) > self.limit:
            self.old, self.young = self.young, _Level(self.kind)
        self.young.add(one[late], two[late], all_sizes[late], gathered(flat, all_starts[late], all_sizes[late]))
        return flat, all_starts, all_sizes

    def joined(self, units: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts of ``counts`` units each."""
        if not len(units):
            return np.empty(0, self.kind), np.zeros(len(counts), np.int64)
        coded = units.dictionary_encode()
        flat, starts, sizes = self.ids(coded.dictionary)
        index = coded.indices.to_numpy()
        own = sizes[index]
        ends = np.r_[0, np.cumsum(own)]
        stops = np.cumsum(counts)
        return gathered(flat, starts[index], own), ends[stops] - ends[stops - counts]
