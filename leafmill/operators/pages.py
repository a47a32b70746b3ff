"""Pages: cleaning, file names, lines, length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..packs import LanguagePack, Settings


def stem(file_name: Column) -> Column:
    """A file's document name: without contents suffix and every ``.pdf``."""
    return F.replace(F.regexp_replace(file_name, r"(?i)_toc_\d+(-\d+)?\.pdf$", ""), F.lit(".pdf"), F.lit(""))


def named_toc_pages(file_name: Column) -> Column:
    """The contents pages that a file name tells: none (null), one, a range; a reversed range is empty."""
    first = F.regexp_extract(file_name, r"(?i)_toc_(\d+)(-\d+)?\.pdf$", 1).try_cast("int")
    last = F.coalesce(F.regexp_extract(file_name, r"(?i)_toc_\d+-(\d+)\.pdf$", 1).try_cast("int"), first)
    pages = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<int>"))
    return F.when(first.isNotNull(), pages)


def latest_files(files: DataFrame, name: str = "file_name") -> DataFrame:
    """One file for each stem: the last by name."""
    w = Window.partitionBy("source").orderBy(F.desc(name))
    return files.withColumn("source", stem(F.col(name))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def explicit_toc_pages(files: DataFrame, pack: LanguagePack = LanguagePack()) -> DataFrame:
    """``(source, toc_pages)``: from the file's name, else from the pack, else null."""
    spark = files.sparkSession
    listed = spark.createDataFrame(list(pack.toc_locations.items()), "source string, listed array<int>")
    named = named_toc_pages(F.col("file_name"))
    some = lambda x: F.when(F.size(x) > 0, x)
    return files.select(stem(F.col("file_name")).alias("source"), named.alias("named")).join(listed, "source", "left").select("source", F.coalesce(some(F.col("named")), some(F.col("listed"))).alias("toc_pages"))


def cleaned_text(text: Column) -> Column:
    """Every line without trailing space, the whole without white space around."""
    return t.strip(F.array_join(F.transform(t.lines_of(F.coalesce(text, F.lit(""))), t.rstrip), "\n"))


def clean_pages(raw: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``raw(source, page, text)`` -> pages long enough to keep; numbers stay."""
    text = raw.withColumn("text", cleaned_text(F.col("text"))).withColumn("n_chars", F.length("text"))
    return text.where(F.col("n_chars") >= settings.min_page_chars)


def without_header(lines: Column) -> Column:
    """A page's lines without a first line that is its number."""
    first = lambda held: t.is_page_number(t.strip(F.element_at(held, 1)))
    return t.let(lines, lambda held: F.when(first(held), F.slice(held, 2, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(held))


def page_stats(pages: DataFrame) -> DataFrame:
    """Per document and in all (source null): pages, least, most and floor of mean length."""
    found = pages.rollup("source").agg(
        F.count("*").alias("n_pages"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.floor(F.sum("n_chars") / F.count("*")).alias("mean_chars"), F.sum("n_chars").alias("total_chars")
    )
    return found
