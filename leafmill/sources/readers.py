"""Readers: PDF folders, JSON lines, JSON documents, stored indexes."""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import pages
from ..packs import Settings

#: bytes of a PDF -> the text of each page, one after the other.
PdfParser = Callable[[bytes], Iterable[str]]
#: Longest reason that is kept.
REASON_CHARS = 300


def pypdf_parser(content: bytes) -> Iterator[str]:
    """Pages by the pypdf library, if it is installed."""
    from pypdf import PdfReader

    for page in PdfReader(io.BytesIO(content)).pages:
        yield page.extract_text() or ""


def missing_libraries(names: Iterable[str] = ("pypdf",)) -> list[str]:
    """Which of the optional libraries a stage would not find; asked before it starts."""
    return [name for name in names if importlib.util.find_spec(name) is None]


def pdf_rows(spark: SparkSession, folder: str, parser: PdfParser = pypdf_parser) -> DataFrame:
    """``(source, file_name, page, text, failure)`` of every ``*.pdf``; of files with one stem the last by name.

    A file that cannot be read, or not further than some page, ends with a row that
    has no text and says why; the pages before it and the other files stay.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    files = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    names = pages.latest_files(files.select("file_name"))
    if not names.take(1):
        raise FileNotFoundError(f"no PDF in {folder}")
    chosen = files.join(names, "file_name").select("source", "file_name", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, name, content in zip(batch["source"], batch["file_name"], batch["content"]):
                rows, page = [], 0
                try:
                    for page, text in enumerate(parser(bytes(content)), 1):
                        rows.append((source, name, page, text, None))
                except Exception as error:  # noqa: BLE001  whatever a damaged file brings about
                    rows.append((source, name, page + 1, None, f"{type(error).__name__}: {error}"[:REASON_CHARS]))
                yield pd.DataFrame(rows, columns=["source", "file_name", "page", "text", "failure"])

    return chosen.mapInPandas(parse, "source string, file_name string, page int, text string, failure string")


def pdf_pages(spark: SparkSession, folder: str, parser: PdfParser = pypdf_parser, settings: Settings = Settings()) -> DataFrame:
    """Clean pages of every ``*.pdf``; damaged files give what can be read of them."""
    return pages.clean_pages(pdf_rows(spark, folder, parser).where("failure is null").select("source", "page", "text"), settings)


def pdf_report(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per document: pages read, empty ones, short ones, kept ones, and why reading ended early."""
    size = F.length(pages.cleaned_text(F.col("text")))
    read = F.col("failure").isNull()
    return rows.groupBy("source").agg(
        F.count_if(read).alias("n_pages"), F.count_if(read & (size == 0)).alias("n_empty"), F.count_if(read & (size > 0) & (size < settings.min_page_chars)).alias("n_short"),
        F.count_if(read & (size >= settings.min_page_chars)).alias("n_kept"), F.max("failure").alias("failure"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines by a fixed schema; blank lines are skipped, or an error if strict."""
    if strict:
        blank = spark.read.text(path).where("trim(value) = ''")
        if blank.take(1):
            raise ValueError(f"blank line in {path}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tagged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of many files, each row with its file's stem in ``_source_file``."""
    found = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return found.withColumn("_source_file", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Question templates in file order; malformed braces are rejected here."""
    found = read_jsonl(spark, path, schemas.TEMPLATE).withColumn("seq", F.monotonically_increasing_id())
    bare = F.regexp_replace("template", r"(?U)\{\w+\}", "")
    if found.where(bare.rlike(r"[{}]")).take(1):
        raise ValueError("a template has braces that are no placeholder")
    return found


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with embeddings, one row of facts) of a stored index."""
    return spark.read.parquet(f"{path}/rows"), spark.read.json(f"{path}/meta")
