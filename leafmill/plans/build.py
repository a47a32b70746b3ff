"""The two offline builds and the query, each one plan over all documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import chunks, entities, questions, retrieval, sections, toc
from ..packs import LanguagePack, Settings
from ..sources import models


@contextmanager
def cached() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``keep`` whose tables stay in the executors' memory until the block ends."""
    held: list[DataFrame] = []

    def keep(table: DataFrame, name: str) -> DataFrame:
        held.append(table.persist())
        return table

    try:
        yield keep
    finally:
        for table in held:
            table.unpersist()


def build_chunks(pages: DataFrame, explicit: DataFrame | None = None, pack: LanguagePack = LanguagePack(), settings: Settings = Settings(), keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Pages -> contents entries -> located sections -> linked chunks.

    ``keep(table, name)`` stores a stage's table and gives it back, for example
    ``cached()``'s; without it stages are computed anew where later ones read
    them again.
    """
    keep = keep or (lambda table, name: table)
    located = keep(toc.toc_pages(toc.page_flags(pages, settings, pack), explicit, settings), "located")
    entries = keep(toc.entries(toc.merged_lines(toc.toc_lines(pages, located, pack))), "entries")
    mapped, _ = sections.heading_pages(entries, pages, located, settings)
    return chunks.document_chunks(keep(mapped, "sections"), pages, pack, settings)


def build_questions(records: DataFrame, templates: DataFrame, pack: LanguagePack = LanguagePack(), settings: Settings = Settings()) -> DataFrame:
    """Entity records -> normalised -> questions, one of each key in a document."""
    clean = entities.normalised_entities(records, pack, settings)
    made = questions.generated(clean, templates, settings)
    return questions.deduplicated(made, ["source_chunk", "question_no"], ["source"], F.size("entities"))


def answer(queries: DataFrame, stored: DataFrame, passages: DataFrame, make: Callable[[], models.Encoder], pack: LanguagePack = LanguagePack(), settings: Settings = Settings()) -> DataFrame:
    """``queries(qid, query)`` -> ``schemas.RESULT``: ranked passages, from stored questions or directly."""
    asked = models.embedded(queries, make, "query", models.QUERY_PREFIX).withColumn("intent", retrieval.intent(F.col("query"), pack))
    suits = lambda path, name: retrieval.section_suits(path, name, pack)
    found = retrieval.retrieve(asked, stored, passages, settings, suits)
    facts = passages.select(F.col("id").alias("passage_id"), *[c for c in ("source", "pdf_page", "section_path", "chunk_type", "text") if c in passages.columns])
    out = found.join(asked.select("qid", "query", "intent"), "qid").join(facts, "passage_id")
    return out.select(*[c for c in schemas.names(schemas.RESULT) if c in out.columns])
