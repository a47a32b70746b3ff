"""Exact vector search and the two-level retrieval on top of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..packs import COMPREHENSIVE, LanguagePack, Settings
from ..shared import written
from . import cells


def normalised(vector: Column) -> Column:
    """A vector of length one; a zero vector stays as it is."""
    squares = F.aggregate(vector, F.lit(0.0), lambda held, x: held + x.cast("double") * x)
    return t.let(F.sqrt(squares), lambda n: F.transform(vector, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda held, x: held + x)


def top_k(queries: DataFrame, index: DataFrame, k: int, id_: str = "id", exclude_self: bool = False, in_cells: int | None = None) -> DataFrame:
    """``queries(qid, embedding)``, ``index(id, embedding)`` -> ``(qid, id, score, rank)``.

    Exact: the index is put in cells (as many as its size asks for, or ``in_cells``)
    and a query meets those that may hold one of its k best, see ``cells``. Equal
    scores are ranked by the smaller id; rows without a vector are left out.
    """
    held = cells.dealt(index, in_cells, id_)
    if held is None:
        return queries.sparkSession.createDataFrame([], "qid long, id long, score double, rank int")
    return cells.search(queries, held, k, exclude_self)


def intent(query: Column, pack: LanguagePack, word_bounds: bool = False) -> Column:
    """The first intent in order of precedence with a keyword inside the query."""
    form = t.query_form(query)
    out = F.lit(pack.intents[-1])
    for name in reversed(pack.intents):
        hit = F.lit(False)
        for word in pack.intent_keywords.get(name, []):
            hit = hit | (form.rlike(rf"(?U)\b\Q{word}\E\b") if word_bounds else form.contains(word))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def section_suits(path: Column, intent_: Column, pack: LanguagePack, transliterate: bool = False) -> Column:
    """Whether a section's titles hold a word of the intent; intents without words suit all."""
    titles = F.lower(F.array_join(F.coalesce(path, F.array().cast("array<string>")), " "))
    titles = F.lower(t.to_latin(titles)) if transliterate else titles
    words = F.create_map(*(x for name, own in pack.intent_sections.items() for x in (F.lit(name), F.array(*map(F.lit, own)) if own else F.array().cast("array<string>"))))
    found = F.try_element_at(words, intent_)
    return found.isNull() | (F.size(found) == 0) | F.exists(found, lambda w: titles.contains(w))


def is_comprehensive(query: Column, pack: LanguagePack, word_bounds: bool = False) -> Column:
    """Whether a query asks for a whole list."""
    return intent(query, pack, word_bounds) == COMPREHENSIVE


def retrieve(queries: DataFrame, questions: DataFrame, passages: DataFrame, settings: Settings = Settings(), suits=None, exclude_self: bool = False) -> DataFrame:
    """Both levels for a batch of queries.

    ``queries(qid, intent, embedding)``, ``questions(id, source_chunk, embedding,
    section_path, query, template_id, ...)``, ``passages(id, chunk_id, embedding,
    section_path, ...)`` -> ``(qid, chunk_id, passage_id, level, rank,
    match_score, matched_query, template_id)``.

    Level 1 ranks stored questions and maps them to passages, the first hit of a
    passage counts; of passages that share a chunk_id it is the last by id. Only
    queries without any such hit go to level 2, the passages themselves. The k
    best are taken before the score and section tests, so fewer than wanted may
    be left.
    """
    suits = suits or (lambda path, name: F.lit(True))
    asked = queries.select("qid", "intent")
    told = [F.col(c) if c in questions.columns else F.lit(None).cast("string").alias(c) for c in ("query", "template_id")]

    first = top_k(queries, questions, settings.question_top, exclude_self=exclude_self).where(F.col("score") >= settings.question_score)
    first = first.join(questions.select("id", "source_chunk", F.col("section_path").alias("_path"), *told), "id").join(asked, "qid").where(suits(F.col("_path"), F.col("intent")))
    known = passages.groupBy(F.col("chunk_id").alias("source_chunk")).agg(F.max("id").alias("passage_id"))
    hit = Window.partitionBy("qid", "source_chunk").orderBy("rank")
    first = first.withColumn("_n", F.row_number().over(hit)).where("_n = 1").join(known, "source_chunk")
    level1 = first.select("qid", F.col("source_chunk").alias("chunk_id"), "passage_id", F.col("score").alias("match_score"), F.col("rank").alias("_rank"), F.lit("question").alias("level"), F.col("query").alias("matched_query"), "template_id")
    # read twice: which queries go on, and the result
    level1, _ = written(level1, "level1")

    late = queries.join(level1.select("qid").distinct(), "qid", "left_anti")
    second = top_k(late, passages, settings.passage_top, exclude_self=exclude_self).where(F.col("score") >= settings.passage_score)
    second = second.join(passages.select("id", "chunk_id", F.col("section_path").alias("_path")), "id").join(asked, "qid").where(suits(F.col("_path"), F.col("intent")))
    none = F.lit(None).cast("string")
    level2 = second.select("qid", "chunk_id", F.col("id").alias("passage_id"), F.col("score").alias("match_score"), F.col("rank").alias("_rank"), F.lit("passage").alias("level"), none.alias("matched_query"), none.alias("template_id"))
    place = Window.partitionBy("qid").orderBy("_rank")
    return level1.unionByName(level2).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= settings.results).drop("_rank")
