"""Sections' text cut to typed chunks: recommendations, tables, lists, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import packs
from ..functions import text as t
from ..packs import LanguagePack, Settings
from ..shared import drop, written
from .pages import without_header
from .runs import islands, next_value, segments
from .sections import section_ids, section_paths, siblings

KEY = ["source", "seq"]


def section_text(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``text``: pages from a section's own to before the next located one's.

    Sections that begin on the next one's page get no text and are left out, as
    are those without a page.
    """
    ranged = next_value(sections, ["source"], ["seq"], "pdf_page", "_next").where("pdf_page is not null")
    body = pages.select("source", F.col("page").alias("_page"), F.array_join(without_header(t.lines_of(F.col("text"))), "\n").alias("_body"))
    last = pages.groupBy("source").agg(F.max("page").alias("_last"))
    # a section's pages one by one, so that pages are met by equality
    end = F.least("_last", F.coalesce(F.col("_next") - 1, F.col("_last")))
    held = ranged.select(*KEY, "pdf_page", "_next").join(last, "source").where(F.col("pdf_page") <= end)
    held = held.select(*KEY, F.explode(F.sequence(F.col("pdf_page").cast("int"), end.cast("int"))).alias("_page"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_page", "_body"))), lambda x: x["_body"]), "\n")
    texts = held.join(body, ["source", "_page"]).groupBy(*KEY).agg(text.alias("text"))
    return ranged.drop("_next").join(texts, KEY).where(t.has_sign(F.col("text")))


def typed_lines(texts: DataFrame, pack: LanguagePack = LanguagePack()) -> DataFrame:
    """Lines of each text with the recommendation, table and list that they are in."""

    def told(line: Column) -> Column:
        def judged(s: Column) -> Column:
            rec, table = t.matches(s, pack.recommendation), t.matches(s, pack.table)
            return F.struct(
                line.alias("line"), rec.alias("_rec"), table.alias("_table"), t.any_match(s, packs.SEGMENT_END).alias("_ends"), t.matches(s, pack.bibliography_line).alias("_bibliography"), t.matches(s, pack.bullet).alias("_bullet"),
                F.when(rec, F.regexp_extract(s, t.U + pack.recommendation, 1)).alias("rec_id"),
                F.when(table, F.regexp_extract(s, t.U + pack.table, 1)).alias("table_id"), F.when(table, t.strip(F.regexp_extract(s, t.U + pack.table, 2))).alias("table_title"),
            )

        return t.let(t.strip_held(line), judged)

    # a line is looked at once, before the windows
    out = texts.select(*KEY, F.posexplode(F.transform(t.lines_of(F.col("text")), told)).alias("line_no", "_l")).select(*KEY, "line_no", "_l.*")
    order = ["line_no"]
    rec, table, ends = F.col("_rec"), F.col("_table"), F.col("_ends")
    out = segments(out, KEY, order, rec, table | F.col("_bibliography") | ends, "rec")
    out = segments(out, KEY, order, table, rec | ends, "tbl")
    return islands(out, KEY, order, F.col("_bullet"), "list", 2).drop("_rec", "_table", "_ends", "_bibliography", "_bullet")


def recommendation_parts(text: Column, pack: LanguagePack, settings: Settings) -> Column:
    """The whole text, or its introduction and items if it is long."""

    def step(held: Column, line: Column) -> Column:
        s = t.strip(line)
        item = t.matches(s, pack.bullet) | t.matches(s, pack.numbered)
        n = F.size(held["items"])
        longer = F.array_append(F.slice(held["items"], 1, F.greatest(n - 1, F.lit(0))), F.concat(F.try_element_at(held["items"], F.lit(-1)), F.lit("\n"), line))
        state = lambda head, items: F.struct(head.alias("head"), items.alias("items"))
        return F.when(item, state(held["head"], F.array_append(held["items"], s))).when(n > 0, state(held["head"], longer)).otherwise(state(F.array_append(held["head"], line), held["items"]))

    empty = F.array().cast("array<string>")
    parts = F.aggregate(
        t.lines_of(text),
        F.struct(empty.alias("head"), empty.alias("items")),
        step,
        lambda held: F.concat(F.filter(F.array(t.strip(F.array_join(held["head"], "\n"))), lambda x: x != ""), held["items"]),
    )
    return F.when(F.length(text) <= settings.recommendation_max, F.array(text)).otherwise(F.transform(parts, t.strip))


KINDS = ["recommendation", "table", "list_item", "paragraph"]


def list_parts(text: Column, items: Column, settings: Settings = Settings()) -> Column:
    """The whole list, or its items if it is long and has enough of them."""
    whole = (F.length(text) <= settings.list_max) | (F.size(items) < settings.list_split_items)
    return F.when(whole, F.array(text)).otherwise(items)


def section_chunks(texts: DataFrame, pack: LanguagePack = LanguagePack(), settings: Settings = Settings()) -> DataFrame:
    """Located sections with text, ids and paths -> chunks, kinds in fixed order.

    Each line is tagged with the items that it belongs to (a list may stand in a
    recommendation); one group-by gathers an item's lines, one join adds what is
    known of its section.
    """
    tag = lambda kind, item: F.when(item.isNotNull(), F.struct(F.lit(kind).alias("kind"), item.cast("int").alias("item")))
    tags = F.filter(F.array(tag(0, F.col("rec")), tag(1, F.col("tbl")), tag(2, F.col("list"))), lambda x: x.isNotNull())
    rest = F.array(F.struct(F.lit(3).alias("kind"), F.lit(0).alias("item")))
    lines = typed_lines(texts, pack).select(*KEY, "line_no", "line", "rec_id", "table_id", "table_title", F.explode(F.when(F.size(tags) > 0, tags).otherwise(rest)).alias("_t"))
    # an item's first line names it; the other lines' names are null
    names = [F.max(F.when(F.col("_t.kind") == kind, F.col(c))).alias(c) for kind, c in ((0, "rec_id"), (1, "table_id"), (1, "table_title"))]
    items = lines.groupBy(*KEY, F.col("_t.kind").alias("kind_rank"), F.col("_t.item").alias("item")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_lines"), *names)
    items = items.withColumn("_lines", F.transform("_lines", lambda x: x["line"]))
    kind = F.col("kind_rank")

    def parts(text: Column) -> Column:
        found = F.when(kind == 0, recommendation_parts(text, pack, settings)).when(kind == 1, F.array(text))
        return found.when(kind == 2, list_parts(text, F.transform("_lines", t.strip), settings)).otherwise(t.packed(t.sentences(text), settings.pack_target, settings.pack_min))

    # as one expression: of a named array a test on its size is inferred, which would have the parts computed again
    pieces = t.let(t.let(t.let(F.array_join("_lines", "\n"), t.strip_held), parts), lambda held: F.transform(held, lambda x: F.struct(x.alias("text"), F.size(held).alias("_total"))))
    rows = items.select(*KEY, "kind_rank", "item", "rec_id", "table_id", "table_title", F.posexplode(pieces).alias("_k", "_p")).select("*", "_p.*").drop("_p")

    base = texts.select(*KEY, "pdf_page", "section_path", "section_ids", F.size("section_ids").alias("section_level"), t.is_summary(F.col("title"), pack).alias("is_summary"), "parent_section_id", "sibling_sections")
    place = F.concat_ws("::", F.col("source"), F.element_at("section_ids", -1), F.concat(F.lit("p"), F.col("pdf_page").cast("string")))
    list_id = F.concat_ws("::", place, F.lit("list"), F.col("item").cast("string"))
    piece = F.concat(F.lit("c"), F.col("_k").cast("string"))
    entry = F.when(F.col("_total") == 1, F.lit("whole")).otherwise(F.concat(F.lit("item"), F.col("_k").cast("string")))
    name = F.when(kind == 0, F.concat_ws("::", place, F.lit("rec"), "rec_id", piece)).when(kind == 1, F.concat_ws("::", place, F.lit("tbl"), "table_id")).when(kind == 2, F.concat_ws("::", list_id, entry)).otherwise(F.concat_ws("::", place, F.lit("p"), piece))
    counted, listed = kind.isin(0, 3), kind == 2
    # stored texts are small by their files' size, their pieces are not: neither is sent to every task, and the pieces lie by section already
    return rows.hint("merge").join(base, KEY).select(
        name.alias("chunk_id"), "source", "pdf_page", "section_path", "section_ids", "section_level",
        F.element_at(F.array(*map(F.lit, KINDS)), kind + 1).alias("chunk_type"), "is_summary", "text", "parent_section_id", "sibling_sections",
        F.col("rec_id").alias("recommendation_id"), F.when(counted, F.col("_k")).alias("chunk_index"), F.when(counted, F.col("_total")).alias("chunk_total"),
        F.when(listed, list_id).alias("list_id"), F.when(listed, F.col("_k")).alias("list_index"), F.when(listed, F.col("_total")).alias("list_total"), F.when(listed, F.lit("bullet")).alias("list_type"),
        "table_id", "table_title", "seq", "kind_rank", (F.col("item").cast("long") * 100_000 + F.col("_k")).alias("item_seq"),
    )


def related(chunks: DataFrame) -> DataFrame:
    """Links to recommendations and tables of the chapter, and to lists of the section."""
    chapter, section = Window.partitionBy("_chapter"), Window.partitionBy("section_ids")
    told = chunks.withColumn("_chapter", F.coalesce(F.try_element_at("section_ids", F.lit(1)), F.lit("_")))

    def linked(name: str, w, summary: bool) -> Column:
        given = F.nullif(F.col(name), F.lit(""))
        every = F.sort_array(F.collect_set(given if summary else F.when(~F.col("is_summary"), given)).over(w))
        return t.let(every, lambda x: t.without(x, given))

    none = F.array().cast("array<string>")
    for out, name in (("related_recommendations", "recommendation_id"), ("related_tables", "table_id")):
        told = told.withColumn("_every", linked(name, chapter, False)).withColumn(out, F.when(F.col("is_summary"), none).otherwise(F.col("_every"))).drop("_every")
    return told.withColumn("related_lists", linked("list_id", section, True)).drop("_chapter")


def document_chunks(sections: DataFrame, pages: DataFrame, pack: LanguagePack = LanguagePack(), settings: Settings = Settings()) -> DataFrame:
    """Located sections and pages -> all chunks, linked.

    Sections are placed once, and their texts put together once; both tables are
    written, as later steps read them several times.
    """
    told, told_path = written(siblings(section_ids(sections)), "sections")
    texts, _ = written(section_text(section_paths(told), pages), "section-texts")
    drop(sections.sparkSession, told_path)
    return related(section_chunks(texts, pack, settings))


def paragraph_chunks(texts: DataFrame, key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """Plain texts packed by sentences: ``(key, chunk_index, chunk_total, text)``."""
    packed = t.packed(t.sentences(F.col("text")), settings.pack_target, settings.pack_min)
    pieces = t.let(packed, lambda held: F.transform(held, lambda x: F.struct(F.size(held).alias("chunk_total"), x.alias("text"))))
    return texts.select(key, F.posexplode(pieces).alias("chunk_index", "_p")).select(key, "_p.chunk_total", "chunk_index", "_p.text")
