"""A training corpus from raw documents, in five stages.

Language ID keeps documents of a learned language, near-duplicate detection keeps
one of each class, decontamination takes out documents that hold a benchmark
item, the secret scan blanks secrets, and SentencePiece encodes what is left and
proves that it decodes to the same text. Each stage's rows are written as Parquet
to the shared folder and read again as the next one's documents.

Defined cases: null and empty texts, and texts without letters, go with the first
stage; a null doc_id is no reason to go, and of a class of near copies a row with
an id stays before one without; of repeated rows one stays; of repeated ids with
different texts each is judged by its own text; other columns, also ones with
names that stages use, come through the first four stages as they are; n_chars is
counted anew where secrets were blanked; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, language, near_copies, pieces, secrets
from leafmill.llm.common import table, written
from leafmill.llm.queries import vocabulary_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the rest goes."""
    return language.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least doc_id, of each class of near copies."""
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark table."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets blanked."""
    return secrets.redacted(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, and the text that they decode to."""
    path = vocabulary_file("piece_bpe_32k.model")
    found = pieces.encoded_and_decoded(docs, path)
    return found.select("doc_id", "n_bytes", "n_pieces", "ids", "decoded", (F.col("text_sha256") == F.col("decoded_sha256")).alias("same"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentence_pieces", sentence_pieces),
]

#: A trained network, an SVD and piece merging have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
