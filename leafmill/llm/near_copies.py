"""One document of each class of near copies, for the pipeline.

Two texts are near copies if the sets of their five-word shingles (lower case)
have a Jaccard similarity of at least 0.8; classes are the connected components.
At that similarity about ten of a fingerprint's 64 bits differ, out of reach of
one-wildcard segments that still tell texts apart. So candidates come from two
indexes: the deletion-variant index of the fingerprint operator, on fingerprints
of five-word shingles, and 24 bands of 6 least hashes, which miss a pair at 0.8
once in 1,470 (0.9993 found), above it less often. Every candidate's similarity
is then counted on its sets of 64-bit shingle hashes.

A band's texts are first held against the band's least text. Only bands whose
texts are still in different components are gone through pair by pair, in cells
of bounded size that give a spanning forest and never their pairs; a band of more
than a cell's hashes is dealt out by pairs of blocks.

Defined cases: a text of fewer than five words is one shingle; null and empty
texts are one class; a row without doc_id is kept only if its class has none
with one; of repeated rows one is kept; a very long text takes 8 bytes for each of
its words in one task; an empty table gives an empty result; columns of any other
name are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, in_parts, text_bytes, unused_name, worker_keeps, written
from .graph import components
from .lookup import gathered
from .simhash import links, majority

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
#: Hashes that meet all of the bands' functions at a time.
BLOCK = 4096
#: Hashes in a block of a band's texts; a cell holds two blocks.
CELL = 1 << 18

_draw = np.random.default_rng(42)
_FLIP = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_TIMES = _draw.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(data: bytes) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    words = data.lower().split()
    if len(words) < SHINGLE:
        runs, n = iter([b" ".join(words)]), 1
    else:
        runs, n = map(b" ".join, zip(*(islice(words, k, None) for k in range(SHINGLE)))), len(words) - SHINGLE + 1
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.dtype("<u8"), n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key of each band of a set's least hashes; the band's number is in the key."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(upper), BLOCK):
        np.minimum(least, ((upper[at : at + BLOCK, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), seed=k) for k in range(BANDS)], np.uint64).view(np.int64)


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_keeps("near_copies")
    for batch in in_parts(batches):
        sizes, keys, prints = [], [], []
        for text in batch.column(2):
            own = shingles(text.as_py())
            sizes.append(len(own))
            keys.append(bands(own))
            prints.append(majority(own))
        held = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(keys) + 1, BANDS, np.int32)), pa.array(np.concatenate(keys)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), held], ["node", "doc_id", "n", "fp", "keys"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_keeps("near_copies")
    for batch in in_parts(batches, 64):
        found = [shingles(x.as_py()).view(np.int64) for x in batch.column(1)]
        held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found)))
        yield pa.RecordBatch.from_arrays([batch.column(0), held], ["node", "hashes"])


def node_of(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def forest(nodes: list[int], roots: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges of similar texts that join a cell's components; equal roots are one component."""
    own = np.unique(np.array(roots, np.int64), return_inverse=True)[1]
    up = list(range(int(own.max(initial=0)) + 1))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    sizes = np.array(list(map(len, sets)), np.int64)
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    postings = row[np.argsort(ids, kind="stable")]
    starts, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    most = np.bincount(own).argmax()  # pairs in different components have a text outside the largest one
    out = []
    for x in np.flatnonzero(own != most).tolist():
        held = ids[ends[x] - sizes[x] : ends[x]]
        both = np.bincount(gathered(postings, starts[held], counts[held]), minlength=len(sets))
        near = (both >= least * (sizes + sizes[x] - both)) & (own != own[x])
        for y in np.flatnonzero(near).tolist():
            a, b = top(int(own[x])), top(int(own[y]))
            if a != b:
                up[a] = b
                out.append((nodes[x], nodes[y]))
    return out


def _cell_batches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (cell, node, root, hashes), sorted by cell -> edges ``(a, b)``."""
    worker_keeps("near_copies")
    cell, nodes, roots, sets = None, [], [], []

    def found() -> Iterator[pa.RecordBatch]:
        edges = forest(nodes, roots, sets, least) if len(set(roots)) > 1 else []
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], ["a", "b"])

    for batch in in_parts(batches):
        for key, node, root, hashes in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
            if key != cell:
                yield from found()
                cell, nodes, roots, sets = key, [], [], []
            nodes.append(node)
            roots.append(root)
            sets.append(hashes.values.to_numpy())
    yield from found()


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets have the least similarity or more."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    held = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return held.where(F.col("both") >= least * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(node, root)`` of every distinct text."""
    spark = docs.sparkSession
    texts = docs.select(node_of().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    found, found_path = written(texts.mapInArrow(_band_batches, "node long, doc_id long, n long, fp long, keys array<long>"), "bands")
    each = found.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    keyed = each.select("node", "n", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.count("*").alias("many"), F.min(F.struct("node", "n")).alias("hub")).where("many > 1")
    members, members_path = written(keyed.join(hubs, "key").select("key", "node", "n", "hub"), "members")
    # The sizes alone rule out that a pair is similar: |x & y| / |x | y| <= min / max.
    fits = lambda x, y: F.least(x, y) >= least * F.greatest(x, y)
    star = members.where((F.col("node") != F.col("hub.node")) & fits(F.col("n"), F.col("hub.n"))).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))

    prints, prints_path = written(found.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    tied, tied_paths = links(prints.select("fp"))
    reps = tied.join(prints.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = found.join(prints, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    pairs, pairs_path = written(star.unionByName(reps).unionByName(same).distinct(), "pairs")
    drop(spark, prints_path, *tied_paths)

    asked = members.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    lone = texts.select("node", "text").join(asked, "node", "left_semi").mapInArrow(_set_batches, "node long, hashes array<long>")
    sets, sets_path = written(lone.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")
    first, first_path = written(similar(pairs, sets, least), "star")
    joined, joined_paths = components(first, "near-star")

    named = members.join(joined, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    blocks = F.ceil(F.sum("n") / CELL).cast("int")
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), blocks.alias("blocks")).where("low <> high").select("key", "blocks")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = named.join(mixed, "key").select("key", "node", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells, cells_path = written(dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "root"), "cells")
    filled = cells.join(sets, "node").select("cell", "node", "root", "hashes").repartition("cell").sortWithinPartitions("cell")
    late = filled.mapInArrow(partial(_cell_batches, least=least), "a long, b long")
    edges, edges_path = written(first.unionByName(late), "near")
    ends, ends_paths = components(edges, "near-copies")
    out, _ = written(found.select("node").distinct().join(ends, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "classes")
    drop(spark, found_path, members_path, pairs_path, sets_path, first_path, cells_path, edges_path, *joined_paths, *ends_paths)
    return out


def one_row_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of each class ``rooted(node, root)`` of texts: the least doc_id's, rows without id last."""
    node, kept, id_, many = (unused_name(docs, x) for x in ("node", "kept", "kept_id", "many"))
    own = docs.withColumn(node, node_of())
    rows = own.groupBy(F.col(node).alias("node"), F.col("doc_id").alias("id")).agg(F.count("*").alias("many"))
    order = F.struct(F.col("id").isNull().alias("late"), "id", "node", "many")
    best = rows.join(rooted, "node").groupBy("root").agg(F.min(order).alias("best"))
    best, _ = written(best.select(F.col("best.node").alias(kept), F.col("best.id").alias(id_), F.col("best.many").alias(many)), "kept")
    held = own.join(best, (F.col(node) == F.col(kept)) & F.col("doc_id").eqNullSafe(F.col(id_)))
    again = held.where(F.col(many) > 1).dropDuplicates([node, "doc_id"])
    return held.where(F.col(many) == 1).unionByName(again).select(*docs.columns)


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class of near copies, as it is."""
    return one_row_each(docs, classes(docs, least))
