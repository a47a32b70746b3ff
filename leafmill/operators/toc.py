"""Tables of contents: finding their pages, parsing their lines to entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import packs
from ..functions import text as t
from ..packs import LanguagePack, Settings


def page_flags(pages: DataFrame, settings: Settings = Settings(), pack: LanguagePack = LanguagePack()) -> DataFrame:
    """Adds each page's line statistics and what it may be in a table of contents."""
    lines = F.filter(F.transform(t.lines_of(F.col("text")), t.strip), lambda x: x != "")
    base = pages.withColumn("_lines", lines)
    listed = F.filter("_lines", lambda x: t.is_toc_line(x, settings))
    base = base.withColumn("_listed", listed).withColumn("n_lines", F.size("_lines"))
    families = F.array_distinct(F.filter(F.transform("_listed", t.marker_family), lambda x: x.isNotNull()))
    base = base.withColumn("toc_ratio", F.when(F.col("n_lines") > 0, F.size("_listed") / F.col("n_lines")).otherwise(F.lit(0.0))).withColumn("n_families", F.size(families))
    base = base.withColumn("imprint", t.is_imprint(F.col("text"), pack)).withColumn("sentences", t.sentence_starts(F.col("text")))
    titled = (F.col("n_lines") >= settings.min_toc_lines) & t.is_title(F.element_at("_lines", 1), pack.contents_titles) & (F.col("toc_ratio") >= settings.toc_ratio_titled)
    untitled = (F.col("n_lines") >= settings.min_toc_lines) & ~F.col("imprint") & (F.col("toc_ratio") >= settings.toc_ratio_untitled) & (F.col("n_families") >= 2)
    continued = (F.col("n_lines") >= 2) & ~F.col("imprint") & (F.col("toc_ratio") >= settings.toc_ratio_continued) & (F.col("n_families") >= 1)
    dotted = F.size(F.filter("_lines", lambda x: x.rlike(r"\.{4,}")))
    heading = F.size(F.filter("_lines", lambda x: (F.length(x) <= 150) & ~t.ends_sentence(x) & ~t.matches(x, f"[.!?]\\s+[{packs.CYRILLIC_UPPER}A-Z]")))
    few = F.col("sentences") <= settings.fallback_sentences
    weak = (F.col("n_lines") >= settings.fallback_lines_weak) & (heading >= settings.fallback_ratio * F.col("n_lines")) & few
    fallback = (F.col("n_lines") >= settings.fallback_lines) & ~F.col("imprint") & F.when(dotted >= settings.fallback_dot_lines, few).otherwise(weak)
    flags = {"is_titled": F.coalesce(titled, F.lit(False)), "is_untitled": untitled, "is_continued": continued, "is_fallback": fallback}
    return base.withColumns(flags).drop("_lines", "_listed")


def toc_pages(flagged: DataFrame, explicit: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """``(source, page, toc_location)`` of each document's table of contents.

    Explicit pages come first; then the first run near the front, the last run
    near the back, and both again by the weaker test. The first that gives any
    page decides.
    """
    whole, order = Window.partitionBy("source"), Window.partitionBy("source").orderBy("page")
    rows = flagged.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("*").over(whole))
    if explicit is not None:
        rows = rows.join(explicit.select("source", F.col("toc_pages").alias("_named_pages")), "source", "left")
        rows = rows.withColumn("_named", F.coalesce(F.array_contains("_named_pages", F.col("page")), F.lit(False)))
    else:
        rows = rows.withColumn("_named", F.lit(False))
    look = F.least(F.lit(settings.lookahead_pages), F.greatest(F.lit(1), F.floor(F.col("_n") / 3)))
    front, back = F.col("_i") <= look, (F.col("_i") > F.col("_n") - look) & (F.col("_i") <= F.col("_n") - settings.skip_end_pages)
    broken = ~(F.col("is_continued") | F.col("is_titled"))
    primary, weak = F.col("is_titled") | F.col("is_untitled"), F.col("is_fallback")
    searches = [("front", front, primary, True), ("back", back, primary, False), ("front-fallback", front, weak, True), ("back-fallback", back, weak, False)]
    # all four searches over the same windows: where a run begins, then where it breaks off
    for k, (_, part, start, ahead) in enumerate(searches):
        rows = rows.withColumn(f"_from{k}", (F.min if ahead else F.max)(F.when(part & start, F.col("_i"))).over(whole))
    for k, (_, part, _, ahead) in enumerate(searches):
        beyond = F.col("_i") > F.col(f"_from{k}") if ahead else F.col("_i") < F.col(f"_from{k}")
        rows = rows.withColumn(f"_to{k}", (F.min if ahead else F.max)(F.when(part & beyond & broken, F.col("_i"))).over(whole))
    found = F.when(F.max("_named").over(whole), F.when(F.col("_named"), F.lit("explicit")))
    for k, (name, part, _, ahead) in enumerate(searches):
        place, first, end = F.col("_i"), F.col(f"_from{k}"), F.col(f"_to{k}")
        inside = (place >= first) & (end.isNull() | (place < end)) if ahead else (place <= first) & (end.isNull() | (place > end))
        found = found.when(first.isNotNull(), F.when(part & inside, F.lit(name)))
    return rows.withColumn("toc_location", found).where("toc_location is not null").select("source", "page", "toc_location")


def toc_lines(pages: DataFrame, located: DataFrame, pack: LanguagePack = LanguagePack()) -> DataFrame:
    """Cleaned lines ``(source, seq, text, printed_page, pdf_page)`` of contents pages."""
    held = pages.join(located.select("source", "page"), ["source", "page"], "left_semi")
    lines = held.select("source", "page", F.posexplode(t.lines_of(F.col("text"))).alias("_n", "line")).where(t.strip(F.col("line")) != "")
    lines = lines.withColumn("_e", t.toc_entry(F.col("line"))).select("source", "page", "_n", F.col("_e.text").alias("text"), F.col("_e.page").alias("printed_page"))
    kept = (F.col("text") != "") & ~t.is_page_number(F.col("text")) & ~t.is_title(F.col("text"), pack.contents_titles)
    kept = kept & ~(t.is_title(F.col("text"), pack.bibliography_titles) & F.col("printed_page").isNull())
    w = Window.partitionBy("source").orderBy("page", "_n")
    return lines.where(kept).select("source", F.row_number().over(w).alias("seq"), "text", "printed_page", F.col("page").alias("pdf_page"))


def merged_lines(lines: DataFrame) -> DataFrame:
    """Continuation lines joined to the entry before them.

    A line without marker joins if the line before neither ends a sentence nor is
    missing, and either it begins in lower case, or that line ends with a comma or
    the like, or its entry is a chapter in roman numerals, another one follows and
    it is a short line in capitals. All but the chapter is told by two lines; and
    whether the entry is such a chapter is what the last line before said that
    settles it: a marker, or a line that could not join. So windows suffice.
    """
    w = Window.partitionBy("source").orderBy("seq")
    before, roman = w.rowsBetween(Window.unboundedPreceding, -1), F.lit("rimski")
    text = F.col("text")
    told = lines.withColumns({"_family": t.marker_family(text), "_style": t.style(text), "_lower": text.rlike(r"\A\p{Ll}"), "_closed": t.ends_sentence(t.rstrip(text)), "_open": t.rstrip(text).rlike(r"[,;:]\z")})
    told = told.withColumns({"_next": F.lead("_family").over(w), "_free": ~F.coalesce(F.lag("_closed").over(w), F.lit(True)) & F.col("_family").isNull(), "_asked": F.coalesce(F.lag("_open").over(w), F.lit(False))})
    joins = F.col("_free") & (F.col("_lower") | F.col("_asked"))
    title = F.col("_free") & ~joins & F.coalesce((F.col("_next") == roman) & (F.col("_style") == "upper") & (F.length("text") < 60), F.lit(False))
    # a line that joins, or that would join a chapter alone, settles nothing
    settled = F.when(F.col("_family").isNotNull(), F.col("_family") == roman).when(~joins & ~title, F.lit(False))
    told = told.withColumns({"_joins": joins, "_title": title, "_settled": settled})
    told = told.withColumn("_chapter", F.coalesce(F.last("_settled", ignorenulls=True).over(before), F.lit(False)))
    told = told.withColumn("_entry", F.sum(F.when(F.col("_joins") | (F.col("_title") & F.col("_chapter")), 0).otherwise(1)).over(w).cast("int"))
    row = F.struct("seq", "text", "printed_page", "pdf_page")
    found = told.groupBy("source", F.col("_entry").alias("seq")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    printed = F.filter(F.transform("_rows", lambda x: x["printed_page"]), lambda x: x.isNotNull())
    return found.select("source", "seq", F.array_join(F.transform("_rows", lambda x: x["text"]), " ").alias("text"), F.try_element_at(printed, F.lit(-1)).alias("printed_page"), F.element_at("_rows", 1)["pdf_page"].alias("pdf_page"))


def entries(merged: DataFrame) -> DataFrame:
    """Entries with marker, style and family; levels by families' first appearance."""
    told = merged.withColumn("_m", t.marker(F.col("text"))).withColumn("style", t.style(F.col("text")))
    told = told.select("source", "seq", t.family(F.col("_m.family"), F.col("style")).alias("family"), "style", F.col("_m.family").alias("marker"), F.col("_m.marker_text").alias("marker_text"), F.col("_m.id").alias("id"), F.col("_m.title").alias("title"), "printed_page")
    return family_levels(told)


def family_levels(entries: DataFrame) -> DataFrame:
    """``level``: the rank of the family's first entry in its document."""
    first = entries.withColumn("_first", F.min("seq").over(Window.partitionBy("source", "family")))
    return first.withColumn("level", F.dense_rank().over(Window.partitionBy("source").orderBy("_first"))).drop("_first")


def toc_documents(sources: DataFrame, located: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per document: where its contents are, families in order, a warning if none."""
    places = located.groupBy("source").agg(F.first("toc_location").alias("toc_location"), F.sort_array(F.collect_set("page")).alias("toc_pages"))
    ranks = entries.groupBy("source", "family").agg(F.min("level").alias("level"))
    families = ranks.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("level", "family"))).alias("_f"))
    found = sources.select("source").distinct().join(places, "source", "left").join(families, "source", "left")
    return found.select(
        "source",
        F.coalesce("toc_location", F.lit("not-found")).alias("toc_location"),
        F.coalesce("toc_pages", F.array().cast("array<int>")).alias("toc_pages"),
        F.coalesce(F.transform("_f", lambda x: x["family"]), F.array().cast("array<string>")).alias("families_order"),
        F.map_from_entries(F.transform("_f", lambda x: F.struct(x["family"], x["level"]))).alias("family_to_level"),
        F.when(F.col("toc_location").isNull(), F.lit("no table of contents found")).alias("warning"),
    )


def parse_toc(pages: DataFrame, explicit: DataFrame | None = None, settings: Settings = Settings(), pack: LanguagePack = LanguagePack()) -> tuple[DataFrame, DataFrame]:
    """Pages -> (entries, located contents pages)."""
    located = toc_pages(page_flags(pages, settings, pack), explicit, settings)
    return entries(merged_lines(toc_lines(pages, located, pack))), located


