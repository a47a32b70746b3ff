"""Keep a chunk index up to date with a growing folder of documents.

    python -m jobs.refresh_chunks --documents FOLDER --output FOLDER --checkpoint FOLDER [--config FILE]

The documents (Parquet files of ``doc_id, text, lang, source``; more columns may
stand beside) are a file stream: a run takes the files that its checkpoint has not
seen and ends. Of the documents in them it takes those that are new or whose text
has changed since they were last taken, cleans them, packs their sentences to
chunks and writes, for each batch of the stream,

* ``documents/batch=N``: the taken documents, cleaned, with the digest of the given text,
* ``chunks/batch=N/lang=L``: their chunks,
* ``vectors/batch=N``, if an encoder is named: the chunks' vectors,
* ``marks/batch=N``: one row that says what was read and written.

``current_chunks`` and ``current_vectors`` give the index as it stands: each
document's chunks of the last batch that took it. Encoding is what costs most, and
only new and changed documents are encoded. A batch writes its own folders only and reads only those
of earlier batches, so a batch that broke off is done again with the same result;
its mark is written last, and what has no mark is not read.

Defined cases: a row without doc_id is counted and left out; of rows of one doc_id
in one batch the one of the largest digest is taken (then of the largest lang and
source); a null text is empty; a document of under ``min_chars`` has no chunks, and
loses those it had; a null, empty or blank lang is filed under ``und``; a document
whose text is as before is not taken again, whatever its lang and source. Files
must not change once they are there, and documents are not removed. An output
belongs to one checkpoint: with another one the run ends with an error.

A document's text is shuffled once, by doc_id, to meet the digests of earlier
batches; rows of one doc_id are reduced before that. Cleaning and packing need no
shuffle.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as t
from leafmill.operators import chunks, pages
from leafmill.packs import Settings
from leafmill.shared import table_if_there
from leafmill.sources import models

from .common import run_from_command_line

log = logging.getLogger("refresh_chunks")

READ = "doc_id bigint, text string, lang string, source string"
DOCUMENT = "doc_id bigint, digest string, lang string, source string, n_chars int, text string, batch bigint"
CHUNK = "doc_id bigint, source string, chunk_id string, chunk_index int, chunk_total int, n_chars int, n_sentences int, text string, batch bigint, lang string"
VECTOR = "chunk_id string, doc_id bigint, embedding array<float>, batch bigint"
MARK = "n_read bigint, n_without_id bigint, n_taken bigint, n_chunks bigint, batch bigint"


@dataclass(frozen=True)
class Config:
    min_chars: int = 100
    pack_target: int = 700
    pack_min: int = 200
    #: New files that one batch takes at most; 0: all.
    files_per_batch: int = 0
    rows_per_file: int = 1_000_000
    #: None, ``hashing`` for hashed words, or the name of a sentence-transformers model.
    encoder: str | None = None

    def make_encoder(self) -> Callable[[], models.Encoder]:
        name = self.encoder
        return models.HashingEncoder if name == "hashing" else lambda: models.SentenceEncoder(name)


def table(spark: SparkSession, output: str, name: str, schema: str) -> DataFrame:
    """All batches of one of the tables that have a mark."""
    marks = spark.read.schema(MARK).parquet(f"{output}/marks")
    if name == "marks":
        return marks
    return spark.read.schema(schema).parquet(f"{output}/{name}").join(marks.select("batch"), "batch", "left_semi")


def last_taken(documents: DataFrame) -> DataFrame:
    """``(doc_id, batch, digest)`` of each document's last batch."""
    last = documents.groupBy("doc_id").agg(F.max(F.struct("batch", "digest")).alias("_last"))
    return last.select("doc_id", "_last.*")


def _current(spark: SparkSession, output: str, name: str, schema: str) -> DataFrame:
    last = last_taken(table(spark, output, "documents", DOCUMENT)).select("doc_id", "batch")
    return table(spark, output, name, schema).join(last, ["doc_id", "batch"], "left_semi")


def current_chunks(spark: SparkSession, output: str) -> DataFrame:
    """The index as it stands after the runs so far."""
    return _current(spark, output, "chunks", CHUNK)


def current_vectors(spark: SparkSession, output: str) -> DataFrame:
    """The vectors of ``current_chunks``, of all runs that named an encoder."""
    return _current(spark, output, "vectors", VECTOR)


def taken(rows: DataFrame, before: DataFrame | None, config: Config) -> DataFrame:
    """The rows' new and changed documents, cleaned; ``before`` has the digests of earlier batches."""
    text = F.coalesce("text", F.lit(""))
    given = rows.where("doc_id is not null").select("doc_id", F.struct(F.sha2(text, 256).alias("digest"), "lang", "source", text.alias("text")).alias("_row"))
    one = given.groupBy("doc_id").agg(F.max("_row").alias("_row")).select("doc_id", "_row.*")
    if before is not None:
        known = last_taken(before).select("doc_id", F.col("digest").alias("_known"))
        one = one.join(known, "doc_id", "left").where(~F.col("digest").eqNullSafe(F.col("_known"))).drop("_known")
    clean = one.withColumn("text", pages.cleaned_text(F.col("text")))
    return clean.select("doc_id", "digest", "lang", "source", F.length("text").alias("n_chars"), "text")


def chunked(documents: DataFrame, config: Config) -> DataFrame:
    """Chunks of cleaned documents, with ids that say where they stand."""
    settings = Settings(pack_target=config.pack_target, pack_min=config.pack_min)
    lang = F.coalesce(F.nullif(t.strip(F.col("lang")), F.lit("")), F.lit("und"))
    key = F.struct("doc_id", "source", lang.alias("lang"))
    parts = chunks.paragraph_chunks(documents.where(F.col("n_chars") >= config.min_chars).withColumn("_key", key), "_key", settings)
    name = F.concat_ws("::", "_key.source", F.col("_key.doc_id").cast("string"), F.lit("p"), F.concat(F.lit("c"), F.col("chunk_index").cast("string")))
    return parts.select("_key.doc_id", "_key.source", name.alias("chunk_id"), "chunk_index", "chunk_total", F.length("text").alias("n_chars"), F.size(t.sentences(F.col("text"))).alias("n_sentences"), "text", "_key.lang")


def take_batch(batch: DataFrame, number: int, output: str, config: Config) -> dict:
    """One batch of rows into its own folders; done again, it replaces itself."""
    spark = batch.sparkSession
    marks = table_if_there(spark, f"{output}/marks", MARK)
    if marks is not None and marks.where(F.col("batch") > number).take(1):
        raise ValueError(f"{output} has batches after {number}: it belongs to another checkpoint")
    before = table(spark, output, "documents", DOCUMENT).where(F.col("batch") < number) if marks is not None else None
    own = {name: f"{output}/{name}/batch={number}" for name in ("documents", "chunks", "vectors", "marks")}
    taken(batch, before, config).write.mode("overwrite").option("maxRecordsPerFile", config.rows_per_file).parquet(own["documents"])
    kept = spark.read.schema(DOCUMENT.removesuffix(", batch bigint")).parquet(own["documents"])
    chunked(kept, config).write.mode("overwrite").option("maxRecordsPerFile", config.rows_per_file).partitionBy("lang").parquet(own["chunks"])
    stored = spark.read.schema(CHUNK.removesuffix(", batch bigint, lang string")).parquet(own["chunks"])
    if config.encoder:
        vectors = models.embedded(stored.select("chunk_id", "doc_id", "text"), config.make_encoder())
        vectors.select("chunk_id", "doc_id", "embedding").write.mode("overwrite").option("maxRecordsPerFile", config.rows_per_file).parquet(own["vectors"])
    # counts of one column, or of files' footers
    told = batch.agg(F.count("*").alias("n_read"), F.count_if(F.col("doc_id").isNull()).alias("n_without_id")).first().asDict()
    told |= {"n_taken": kept.count(), "n_chunks": stored.count()}
    mark = spark.range(1).select(*[F.lit(told[c]).cast("bigint").alias(c) for c in ("n_read", "n_without_id", "n_taken", "n_chunks")])
    mark.coalesce(1).write.mode("overwrite").parquet(own["marks"])
    log.info("batch %d: read %d rows (%d without doc_id), took %d documents, wrote %d chunks to %s", number, *told.values(), own["chunks"])
    return told


def refresh(spark: SparkSession, documents: str, output: str, checkpoint: str, config: Config = Config()) -> dict:
    """Take what is new in ``documents``; tells the sums over this run's batches."""
    total = {"n_batches": 0, "n_read": 0, "n_without_id": 0, "n_taken": 0, "n_chunks": 0}

    def take(batch: DataFrame, number: int) -> None:
        for name, n in take_batch(batch, number, output, config).items():
            total[name] += n
        total["n_batches"] += 1

    # as a pattern, so that a single file may be given as well as a folder
    path = documents.rstrip("/")
    path = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    # a file's age says nothing about whether it has been read
    stream = spark.readStream.schema(READ).option("maxFileAge", "36500d")
    if config.files_per_batch:
        stream = stream.option("maxFilesPerTrigger", config.files_per_batch)
    log.info("reading what is new in %s", documents)
    query = stream.parquet(path).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("wrote %s to %s", total, output)
    return total


def main(argv: list[str] | None = None) -> dict:
    paths = {"documents": "folder, file or pattern of Parquet files", "output": "folder of the index", "checkpoint": "folder of the stream's checkpoint"}
    return run_from_command_line("refresh_chunks", __doc__, paths, Config, refresh, argv)


if __name__ == "__main__":
    main()
