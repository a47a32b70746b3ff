"""The queries of this subpackage: thin, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, language, licences, media, pieces, secrets, simhash, substrings, token_files, urls, wordpieces
from .common import table


def vocabulary_file(name: str) -> str:
    """A file of the installed package of public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents")).drop("spans")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.counted(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(table(spark, sf_dir, "pages"))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_dedup": op1_simhash_dedup,
        "op2_media_columns": op2_media_columns,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_secret_scan": op4_secret_scan,
        "op5_token_counts": op5_token_counts,
        "op6_token_files": op6_token_files,
        "op7_language_id": op7_language_id,
        "op8_url_filter": op8_url_filter,
        "op9_sentence_pieces": op9_sentence_pieces,
        "op10_decontamination": op10_decontamination,
        "op11_source_divergence": op11_source_divergence,
        "op12_licence_scan": op12_licence_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": substrings.oracle(), "op8_url_filter": urls.oracle(), "op11_source_divergence": divergence.oracle()}
