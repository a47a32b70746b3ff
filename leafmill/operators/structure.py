"""The alternative reading of a document: headings and recommendations from its lines."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..packs import LanguagePack, Settings
from .pages import without_header
from .runs import as_of, leads_before


def document_lines(pages: DataFrame) -> DataFrame:
    """All lines of a document in one order: ``(source, line_no, page, line)``."""
    lines = pages.select("source", "page", F.posexplode(without_header(t.lines_of(F.col("text")))).alias("_n", "line"))
    w = Window.partitionBy("source").orderBy("page", "_n")
    return lines.withColumn("line_no", F.row_number().over(w)).drop("_n")


def flagged_lines(lines: DataFrame, settings: Settings = Settings(), pack: LanguagePack = LanguagePack()) -> DataFrame:
    """Adds what each line may be, and whether it is an accepted heading.

    Only three kinds of line change the state of being inside a recommendation:
    one that opens it, an accepted first-level heading and a bibliography line.
    Headings of deeper levels count outside only, so they never change it.
    """
    s = t.strip(F.col("line"))
    told = lines.withColumn("heading", t.heading_candidate(F.col("line"))).withColumn("_sentence", t.is_sentence_line(F.col("line")))
    told = leads_before(told, ["source"], ["line_no"], F.col("_sentence"), F.col("heading").isNotNull(), settings.lookahead_lines, "_body")
    told = told.withColumn("rec_id", F.when(t.matches(s, pack.recommendation), F.regexp_extract(s, t.U + pack.recommendation, 1)))
    told = told.withColumn("_good", F.col("rec_id").isNull() & F.col("heading").isNotNull() & ~t.is_reference(F.col("heading.title")) & F.col("_body"))
    closing = t.matches(F.col("line"), r"^\s*Литература\s*$") & F.col("heading").isNull()
    event = F.when(F.col("rec_id").isNotNull(), F.col("line_no")).when((F.col("_good") & (F.col("heading.level") == 1)) | closing, F.lit(0))
    told = told.withColumn("_event", event).withColumn("_closing", closing)
    w = Window.partitionBy("source").orderBy("line_no")
    told = told.withColumn("_open", F.coalesce(F.last("_event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    accepted = F.col("_good") & ((F.col("heading.level") == 1) | (F.col("_open") == 0))
    plain = (s != "") & F.col("rec_id").isNull() & F.col("heading").isNull() & ~F.col("_closing") & (F.col("_open") > 0)
    return told.withColumn("is_heading", accepted).withColumn("rec_line", F.when(plain, F.col("_open"))).drop("_sentence", "_body", "_good", "_event", "_closing", "_open")


def headings(flagged: DataFrame) -> DataFrame:
    """Accepted headings as sections: ``(source, seq, id, title, level, page)``."""
    w = Window.partitionBy("source").orderBy("line_no")
    return flagged.where("is_heading").select("source", F.row_number().over(w).alias("seq"), "heading.id", "heading.title", "heading.level", "page")


def recommendations(flagged: DataFrame, sections: DataFrame) -> DataFrame:
    """``(source, line_no, id, page, section_id, text)``; the section is the last one at or before the page."""
    opened = flagged.where("rec_id is not null").select("source", "line_no", F.col("rec_id").alias("id"), "page")
    rows = flagged.where("rec_line is not null").groupBy("source", F.col("rec_line").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("n"), "line"))).alias("_l"))
    text = F.coalesce(t.strip(F.array_join(F.transform("_l", lambda x: x["line"]), "\n")), F.lit(""))
    held = opened.join(rows, ["source", "line_no"], "left").withColumn("text", text).drop("_l")
    return as_of(held, sections.select("source", "page", "seq", "id"), ["source"], "page", "seq", "id", "section_id")


def parse_structure(pages: DataFrame, settings: Settings = Settings(), pack: LanguagePack = LanguagePack()) -> tuple[DataFrame, DataFrame]:
    """Pages -> (sections, recommendations)."""
    flagged = flagged_lines(document_lines(pages), settings, pack)
    found = headings(flagged)
    return found, recommendations(flagged, found)


def hierarchy(sections: DataFrame) -> DataFrame:
    """``(source, sections, n_sections)``: each document's sections as nested JSON, and how many they are.

    A section's children are the later ones of a greater level, up to the next of
    its own or a smaller one. Nesting has no bound, so the documents' trees are
    built in Python, each on its own.
    """

    def nested(rows: pd.DataFrame) -> pd.DataFrame:
        root: list[dict] = []
        stack: list[dict] = []
        for r in rows.sort_values("seq").to_dict("records"):
            node = {k: r[k] for k in ("id", "title", "level", "page")} | {"children": []}
            while stack and stack[-1]["level"] >= node["level"]:
                stack.pop()
            (stack[-1]["children"] if stack else root).append(node)
            stack.append(node)
        return pd.DataFrame({"source": rows["source"].iloc[:1], "sections": [json.dumps(root, ensure_ascii=False, default=int)], "n_sections": [len(rows)]})

    wanted = sections.select("source", F.col("seq").cast("int").alias("seq"), "id", "title", F.col("level").cast("int").alias("level"), F.col("page").cast("int").alias("page"))
    return wanted.groupBy("source").applyInPandas(nested, "source string, sections string, n_sections int")
