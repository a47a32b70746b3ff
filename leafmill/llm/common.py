"""Shared plumbing: tables in the shared folder, Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop, new_path, shared_dir, written  # noqa: F401  for this subpackage's modules

#: Rows of a batch that an operator handles at a time; texts may be long.
ARROW_ROWS = 512
#: Bytes after which an operator hands a batch back.
ARROW_BYTES = 8 << 20
#: Schemes of Spark and of pyarrow for the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, without copies.

    Spark bounds a batch by bytes (64 MB unless the session says otherwise), so a
    worker holds that much at a time, or one longer row; what an operator makes
    of a batch is bounded by its slices.
    """
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def rows_out(schema: pa.Schema, rows: Iterator[tuple], weigh=None, limit: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """Gather rows to batches of about ``limit`` bytes (``weigh`` gives a row's)."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weigh(row) if weigh else 64
        if size >= limit:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows), schema)], schema=schema)


def together(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list]]:
    """Batches of (id, text) as lists, gathered to about ``limit`` of the texts' length."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(own)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


_kept: dict = {}


def worker_keeps(family: str) -> dict:
    """What this Python worker keeps for one family of operations, between tasks.

    A worker that turns to another family forgets the earlier one's, so that a
    pipeline's stages do not add up in memory.
    """
    if family not in _kept:
        _kept.clear()
        _kept[family] = {}
    return _kept[family]


def unused_name(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(name: str = "text"):
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_path(uri: str) -> tuple[object, str]:
    """A pyarrow file system and the path in it, for an executor's own writes.

    Names that pyarrow has otherwise than Spark are put as pyarrow has them.
    """
    from pyarrow import fs

    scheme = urlparse(uri).scheme
    if not scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + uri[len(scheme) :])
