"""Exact inner-product search over vectors in cells, by bounds instead of all pairs.

The index's vectors are dealt to cells, each around a centre; a cell knows its
size and its radius, the largest distance of a vector from the centre. For a query
q no vector of a cell scores more than ``q.c + |q| r`` (Cauchy and Schwarz). So a
query first meets the cells whose centres score best, until they hold k vectors;
the k-th best score there is its floor, and of the other cells it meets those
whose bound reaches the floor. That gives the same rows as all pairs.

Vectors stand in blocks, one row each, that the tasks which read them put together;
queries are put together by the cells that they meet, and both sides join on the
cell. A cell of very many vectors is many rows, a query that meets many cells is
in many rows, and nothing of either side passes through the driver. What it gets
is bounded: ``MOST_CELLS`` centres, radii and sizes, fitted on ``SAMPLE`` vectors a
cell at most; every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

MOST_CELLS = 4096
#: An index of fewer vectors is one cell, which every query meets.
ONE_CELL = 20_000
#: Vectors for each cell on which centres are fitted, and rounds of it.
SAMPLE = 64
ROUNDS = 2
#: Vectors of a block, queries of a pack, and bytes after which a task hands them all on.
BLOCK = 1024
PACK = 256
HELD_BYTES = 64 << 20
#: Pairs of query and cell that are looked at together, and bytes of rows that go on together.
PAIRS = 1 << 14
SENT_BYTES = 4 << 20
#: Scores are rounded to so many digits; bounds are taken a little wider.
DIGITS = 12
SLACK = 1e-9


@dataclass(frozen=True)
class Cells:
    """An index in cells: its blocks (cell, ids, vectors) and what the driver knows of them."""

    blocks: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's cell, and its distance from the centre, rounded up."""
    cell = np.argmin((centres**2).sum(axis=1) - 2 * vectors @ centres.T, axis=1)
    return cell, np.linalg.norm(vectors - centres[cell], axis=1) * (1 + SLACK) + SLACK


class _Packer:
    """Gathers (number, vector) by cell and hands them on in rows."""

    def __init__(self, most: int):
        self.most, self.held, self.bytes = most, {}, 0

    def add(self, cell: np.ndarray, numbers: np.ndarray, vectors: np.ndarray, extra: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.diff(cell[order])) + 1
        for own in np.split(order, cuts) if len(order) else []:
            at = int(cell[own[0]])
            self.held.setdefault(at, []).append((numbers[own], vectors[own], extra[own]))
            self.bytes += vectors[own].nbytes
            if sum(len(x[0]) for x in self.held[at]) >= self.most:
                yield from self._rows(at)
        if self.bytes > HELD_BYTES:
            yield from self.rest()

    def _rows(self, at: int) -> Iterator[tuple]:
        numbers, vectors, extra = (np.concatenate(x) for x in zip(*self.held.pop(at)))
        self.bytes -= vectors.nbytes
        for k in range(0, len(numbers), self.most):
            part = slice(k, k + self.most)
            yield at, numbers[part], vectors[part].ravel(), extra[part]

    def rest(self) -> Iterator[tuple]:
        for at in list(self.held):
            yield from self._rows(at)


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows as they come, few at a time, never all that a packer holds."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row[2].nbytes
        if size >= SENT_BYTES:
            yield _batch(held, names)
            held, size = [], 0
    if held:
        yield _batch(held, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cells, numbers, vectors, extra = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(numbers, pa.list_(pa.int64())), pa.array(vectors, pa.list_(pa.float64())), pa.array(extra, pa.list_(pa.float64()))], names)


def _vectors_of(df: DataFrame, id_: str) -> DataFrame:
    return df.where("embedding is not null").select(F.col(id_).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _fitted(vectors: DataFrame, cells: int) -> np.ndarray:
    """Centres: vectors by the hash of their id, then means of the sample's vectors around them."""
    sample, _ = written(vectors.orderBy(F.xxhash64("id"), "id").limit(cells * SAMPLE), "cells-sample")
    first = sample.orderBy(F.xxhash64("id"), "id").limit(cells).collect()
    centres = np.unique(np.array([r.embedding for r in first]), axis=0)
    for _ in range(ROUNDS):

        def summed(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for batch in batches:
                if len(batch):
                    own = _matrix(batch.column(1))
                    cell, _ = _nearest(own, centres)
                    np.add.at(sums, cell, own)
                    np.add.at(n, cell, 1)
            met = np.flatnonzero(n)
            cell, place = np.repeat(met, sums.shape[1]), np.tile(np.arange(sums.shape[1]), len(met))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(place), pa.array(sums[met].ravel()), pa.array(n[cell])], ["cell", "place", "total", "n"])

        means = sample.mapInArrow(summed, "cell long, place long, total double, n long").groupBy("cell", "place").agg((F.sum("total") / F.sum("n")).alias("mean"))
        centres = centres.copy()
        for r in means.collect():
            centres[r.cell, r.place] = r["mean"]
    return centres


def dealt(index: DataFrame, cells: int | None = None, id_: str = "id") -> Cells | None:
    """An index in cells, written to the shared folder; None if it has no vectors."""
    vectors = _vectors_of(index, id_)
    first = vectors.first()
    if first is None:
        return None
    if cells is None:
        n = vectors.count()
        cells = 1 if n < ONE_CELL else min(MOST_CELLS, math.ceil(math.sqrt(n)))
    centres = _fitted(vectors, min(cells, MOST_CELLS)) if cells > 1 else np.zeros((1, len(first.embedding)))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, packer = ["cell", "ids", "vectors", "distances"], _Packer(BLOCK)
        for batch in batches:
            if len(batch):
                own = _matrix(batch.column(1))
                cell, far = _nearest(own, centres)
                yield from _batches(packer.add(cell, batch.column(0).to_numpy(zero_copy_only=False), own, far), names)
        yield from _batches(packer.rest(), names)

    made = vectors.mapInArrow(block, "cell int, ids array<long>, vectors array<double>, distances array<double>")
    blocks, _ = written(made.select("cell", "ids", "vectors", F.array_max("distances").alias("radius")), "cells")
    radius, sizes = np.full(len(centres), -1.0), np.zeros(len(centres), np.int64)
    for r in blocks.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum(F.size("ids")).alias("n")).collect():
        radius[r.cell], sizes[r.cell] = r.radius, r.n
    return Cells(blocks.drop("radius"), centres, radius, sizes)


def _met(vectors: np.ndarray, floors: np.ndarray, cells: tuple[np.ndarray, np.ndarray, np.ndarray], wanted: int, late: bool) -> np.ndarray:
    """Which cells each query meets, first or after its floor is known."""
    centres, radius, sizes = cells
    scores = vectors @ centres.T
    scores[:, sizes == 0] = -np.inf
    order = np.argsort(-scores, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    first = np.zeros(scores.shape, bool)
    np.put_along_axis(first, order, before < wanted, axis=1)
    first &= sizes > 0
    if not late:
        return first
    bounds = scores + np.linalg.norm(vectors, axis=1, keepdims=True) * radius
    return ~first & (sizes > 0) & (bounds + SLACK * (1 + np.abs(bounds)) >= floors[:, None])


def _best(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score) each query's k best, equal scores by the smaller id."""
    q, ids, scores = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[place < k], ids[place < k], scores[place < k]


def _scores(packs: DataFrame, blocks: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Packs of queries against the blocks of their cells -> each task's k best of every query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for at in range(len(batch)):
                qids, queries, floors, ids, vectors = (batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in range(5))
                scores = np.round(vectors.reshape(len(ids), -1) @ queries.reshape(len(qids), -1).T, DIGITS)
                if exclude_self:
                    scores[ids[:, None] == qids[None, :]] = -np.inf
                # the k best of each query and all that equal the last of them
                least = np.partition(scores, len(ids) - k, axis=0)[len(ids) - k] if len(ids) > k else np.full(len(qids), -np.inf)
                row, column = np.nonzero((scores >= np.maximum(least, floors)) & np.isfinite(scores))
                held.append((qids[column], ids[row], scores[row, column]))
            if sum(len(x[0]) for x in held) > 1 << 18:
                best = _best(held, k)
                # what many queries leave goes on, a window finds the best of all
                held = [best] if len(best[0]) < 1 << 17 else []
                if not held:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["qid", "id", "score"])
        if held and sum(len(x[0]) for x in held):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(held, k)], ["qid", "id", "score"])

    both = packs.join(blocks, "cell").select("qids", "queries", "floors", "ids", "vectors")
    return both.mapInArrow(scan, "qid long, id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _packed(queries: DataFrame, index: Cells, wanted: int, late: bool) -> DataFrame:
    """Queries (id, embedding, floor) by the cells that they meet."""
    cells = index.centres, index.radius, index.sizes

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, packer = ["cell", "qids", "queries", "floors"], _Packer(PACK)
        # few at a time, as each may meet every cell
        most = max(1, min(PACK, PAIRS // len(cells[0])))
        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                own, floors = _matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)
                query, cell = np.nonzero(_met(own, floors, cells, wanted, late))
                yield from _batches(packer.add(cell, part.column(0).to_numpy(zero_copy_only=False)[query], own[query], floors[query]), names)
        yield from _batches(packer.rest(), names)

    return queries.select("id", "embedding", "floor").mapInArrow(pack, "cell int, qids array<long>, queries array<double>, floors array<double>")


def search(queries: DataFrame, index: Cells, k: int, exclude_self: bool = False) -> DataFrame:
    """``queries(qid, embedding)`` -> ``(qid, id, score, rank)`` of each one's k best."""
    asked = _vectors_of(queries, "qid")
    low = asked.withColumn("floor", F.lit(float("-inf")))
    wanted = k + 1 if exclude_self else k
    near = _ranked(_scores(_packed(low, index, wanted, False), index.blocks, k, exclude_self), k)
    if len(index.centres) == 1:
        return near
    near, _ = written(near, "cells-near")
    floors = near.where(F.col("rank") == k).select(F.col("qid").alias("id"), F.col("score").alias("_floor"))
    floored = asked.join(floors, "id", "left").select("id", "embedding", F.coalesce("_floor", F.lit(float("-inf"))).alias("floor"))
    far = _scores(_packed(floored, index, wanted, True), index.blocks, k, exclude_self)
    return _ranked(near.drop("rank").unionByName(far), k)


def share_read(queries: DataFrame, index: Cells, k: int, found: DataFrame, exclude_self: bool = False) -> DataFrame:
    """``(qid, cells_met, vectors_met, share)``: how much of the index each query of ``search`` meets."""
    wanted, sizes, cells = (k + 1 if exclude_self else k), index.sizes, (index.centres, index.radius, index.sizes)
    floors = found.where(F.col("rank") == k).select(F.col("qid").alias("id"), F.col("score").alias("_floor"))
    asked = _vectors_of(queries, "qid").join(floors, "id", "left").select("id", "embedding", F.coalesce("_floor", F.lit(float("-inf"))).alias("floor"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), PACK):
                part = batch.slice(at, PACK)
                own, floors = _matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)
                met = _met(own, floors, cells, wanted, False) | _met(own, floors, cells, wanted, True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(met.sum(axis=1)), pa.array(met @ sizes)], ["qid", "cells_met", "vectors_met"])

    return asked.mapInArrow(count, "qid long, cells_met long, vectors_met long").withColumn("share", F.col("vectors_met") / int(index.sizes.sum()))
