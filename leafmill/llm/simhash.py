"""Near-duplicate documents by 64-bit fingerprints and deletion variants.

Two fingerprints that differ in at most three bits agree, in at least one of
their two 32-bit segments, but for one bit. So each segment is indexed 32 times
with one bit left out; equal keys bring candidates together and a bit count
verifies them. A key's fingerprints are joined by a spanning forest, never by
all their pairs; keys with very many fingerprints are dealt out in blocks.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; a null doc_id keeps its row; repeated rows get equal results; an empty
table gives an empty result; other columns are not read; of a very long text one
task holds the words, and ``HASH_BLOCK`` hashes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, text_bytes, worker_keeps, written
from .graph import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Shingles hashed at a time, so that a very long text needs bounded memory.
HASH_BLOCK = 1 << 16
#: Fingerprints under one key that one task compares; more are dealt out.
KEY_BLOCK = 4096

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The majority bits of the hashes of word shingles, repeats included."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle))))
        n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, HASH_BLOCK):
        size = min(HASH_BLOCK, n - at)
        ones += _ones(np.fromiter(map(_hash, islice(shingles, size)), np.dtype("<u8"), size))
    return _fingerprint_of(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)


def _fingerprint_of(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes."""
    ones = sum((_ones(hashes[at : at + HASH_BLOCK]) for at in range(0, len(hashes), HASH_BLOCK)), np.zeros(64, np.int64))
    return _fingerprint_of(ones, len(hashes))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_keeps("simhash")
    for batch in batches:
        texts = batch.column(1)
        prints = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of every whole text; fp holds the 64 bits as a long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def variant_keys(fp: str = "fp"):
    """The 64 keys of a fingerprint: which bit is left out, then the segment."""
    high = F.shiftrightunsigned(F.col(fp), 32)
    low = F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))
    keys = []
    for kind, segment in enumerate((high, low)):
        for bit in range(32):
            keep = 0xFFFFFFFF ^ (1 << bit)
            keys.append(segment.bitwiseAND(F.lit(keep)).bitwiseOR(F.lit((32 * kind + bit) << 32)))
    return F.array(*keys)


def forest(values: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the components of distinct uint64 values under a bit bound."""
    roots, leaves, left = [], [], values
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root], values.dtype)
        while len(front) and len(left):
            reached = []
            for at in range(0, len(front), 64):
                block = front[at : at + 64]
                near = (np.bitwise_count(block[:, None] ^ left[None, :]) <= most).any(axis=0)
                if near.any():
                    reached.append(left[near])
                    left = left[~near]
                    if not len(left):
                        break
            front = np.concatenate(reached) if reached else left[:0]
            roots.append(np.full(len(front), root, values.dtype))
            leaves.append(front)
    join = lambda parts: np.concatenate(parts) if parts else values[:0]
    return join(roots), join(leaves)


def _link_batches(batches: Iterator[pa.RecordBatch], block: int, most: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys -> links ``(a, b, null)``; long runs -> ``(fp, null, key)``.

    Rows come sorted by key. whole: link runs of any length.
    """
    key_held, fp_held, long_key = np.empty(0, np.int64), np.empty(0, np.int64), None

    def linked(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        sizes = ends - starts
        pairs = starts[sizes == 2]
        x, y = fps[pairs].view(np.uint64), fps[pairs + 1].view(np.uint64)
        near = (np.bitwise_count(x ^ y) <= most) & (x != y)
        found = [(x[near], y[near])]
        for k in np.flatnonzero(sizes > 2):
            found.append(forest(np.unique(fps[starts[k] : ends[k]]).view(np.uint64), most))
        a = np.concatenate([f[0] for f in found]).view(np.int64)
        b = np.concatenate([f[1] for f in found]).view(np.int64)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])

    def put_off(key: int, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array(np.full(len(fps), key))], ["a", "b", "key"])

    for batch in batches:
        keys = np.concatenate([key_held, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fp_held, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(keys):
            continue
        if long_key is not None:
            own = int(np.searchsorted(keys, long_key, side="right"))
            if own:
                yield put_off(long_key, fps[:own])
            keys, fps = keys[own:], fps[own:]
            if len(keys):
                long_key = None
            else:
                key_held, fp_held = keys, fps
                continue
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        yield from linked(keys[:last], fps[:last]) if last else ()
        key_held, fp_held = keys[last:], fps[last:]
        if len(key_held) > block and not whole:
            long_key = int(key_held[0])
            yield put_off(long_key, fp_held)
            key_held, fp_held = key_held[:0], fp_held[:0]
    if len(key_held):
        yield from linked(key_held, fp_held)


def links(prints: DataFrame, most: int = MAX_BITS, block: int = KEY_BLOCK) -> tuple[DataFrame, list[str]]:
    """Edges between distinct fingerprints that keep every link's connection."""
    spark = prints.sparkSession
    keyed = prints.select(F.explode(variant_keys()).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    first, path = written(keyed.mapInArrow(partial(_link_batches, block=block, most=most, whole=False), "a long, b long, key long"), "links")
    found = first.where("key is null").select("a", "b")
    late = first.where("key is not null").select("key", F.col("a").alias("fp"))
    if late.take(1):
        count = late.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
        own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        dealt = late.join(count, "key").select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        cells = dealt.select(cell.alias("key"), "fp").repartition("key").sortWithinPartitions("key")
        more = cells.mapInArrow(partial(_link_batches, block=block, most=most, whole=True), "a long, b long, key long")
        found = found.unionByName(more.select("a", "b"))
    return found, [path]


def near_duplicates(docs: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fingerprint, component_id)``."""
    spark = docs.sparkSession
    prints, _ = written(fingerprints(docs), "fingerprints")
    texts, texts_path = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    edges, edge_paths = links(texts.select("fp"), most)
    tied, tied_paths = components(edges, "simhash")
    drop(spark, *edge_paths)
    rooted = texts.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named, _ = written(rooted.join(least, "root").select("fp", "component_id"), "named")
    drop(spark, texts_path, *tied_paths)
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
