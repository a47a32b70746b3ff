"""Documents as a stream: one row is one whole document, so every row operator runs as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunks, pages
from ..packs import Settings


def document_stream(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def chunk_stream(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Cleaned documents packed to paragraph chunks, without state."""
    clean = docs.withColumn("text", pages.cleaned_text(docs["text"]))
    return chunks.paragraph_chunks(clean.where(f"length(text) >= {settings.min_page_chars}"), "doc_id", settings)


def append_chunks(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's chunks; the checkpoint makes a restarted query go on."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")  # a repeated epoch replaces itself

    return chunk_stream(docs).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
