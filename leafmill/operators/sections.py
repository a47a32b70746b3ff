"""Sections: hierarchy, siblings, titles of a path, pages of headings."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..packs import Settings
from ..shared import written


def _in_order(sections: DataFrame, group: list[str], level: Column, own: Column, told: Callable[[list, tuple, object, object], object], name: str, kind: str) -> DataFrame:
    """Adds a column that ``told(stack, key, level, own)`` gives for each row of a group, in order of ``seq``.

    A group's rows come one after the other, sorted, with a stack of those that are
    still open; a row is pushed and popped once, and no group is held as a whole.
    """
    keyed = sections.withColumns({"_level": level, "_own": own})
    place = [keyed.columns.index(c) for c in [*group, "_level", "_own"]]
    schema = sections.withColumn(name, F.lit(None).cast(kind)).schema
    as_arrow = {"bigint": pa.int64(), "array<string>": pa.list_(pa.string())}[kind]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stack = None, []
        for batch in batches:
            out = []
            for *key, x, y in zip(*(batch.column(k).to_pylist() for k in place)):
                if key != held:
                    held, stack = key, []
                out.append(told(stack, key, x, y))
            kept = [k for k, f in enumerate(batch.schema) if f.name not in ("_level", "_own")]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(out, as_arrow)], [*[batch.schema.field(k).name for k in kept], name])

    return keyed.repartition(*group).sortWithinPartitions(*group, "seq", "_level", "_own").mapInArrow(walk, schema)


def section_ids(sections: DataFrame) -> DataFrame:
    """Adds ``section_ids`` (path from the root, own id last) and ``parent_section_id``.

    A section's ancestors are the open sections of levels below its own. Without
    an id it is called by its title's slug, else by its place.
    """
    own = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.nullif(t.slug(F.coalesce("title", F.lit(""))), F.lit("")))

    def told(stack: list, key: tuple, level: int, name: str | None) -> list[str]:
        # the first element counts the rows so far
        if not stack:
            stack.append(-1)
        stack[0] += 1
        while len(stack) > 1 and stack[-1][0] >= level:
            stack.pop()
        name = f"S{stack[0]}" if name is None else name
        stack.append((level, f"{stack[-1][1]}.{name}" if len(stack) > 1 else f"{key[0]}::{name}"))
        return [x[1] for x in stack[1:]]

    paths = _in_order(sections, ["source"], F.coalesce("level", F.lit(1)), own, told, "section_ids", "array<string>")
    return paths.withColumn("parent_section_id", F.when(F.size("section_ids") >= 2, F.element_at("section_ids", -2)))


def ancestors(sections: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``parent_seq``: the nearest earlier row of a smaller level, of any number of levels.

    A row without level has no parent, and none before it is anyone's afterwards.
    """

    def told(stack: list, key: tuple, level: int | None, seq: int) -> int | None:
        while stack and (level is None or stack[-1][0] >= level):
            stack.pop()
        parent = stack[-1][1] if stack else None
        if level is not None:
            stack.append((level, seq))
        return parent

    return _in_order(sections, group, F.col("level").cast("int"), F.col("seq").cast("long"), told, "parent_seq", "bigint")


def siblings(sections: DataFrame) -> DataFrame:
    """Adds ``sibling_sections``: other ids under the same parent, in order."""
    own = F.element_at("section_ids", -1)
    w = Window.partitionBy("source", "parent_section_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", own.alias("id"))).over(w)), lambda x: x["id"])
    return sections.withColumn("_all", listed).withColumn("sibling_sections", t.without(F.col("_all"), own)).drop("_all")


def section_paths(sections: DataFrame) -> DataFrame:
    """Adds ``section_path``: for each id of the path, the title of the first section on it."""
    steps = sections.select("source", "seq", "title", F.posexplode("section_ids").alias("_k", "_id"))
    titles = steps.groupBy("source", "_id").agg(F.min_by(F.coalesce("title", F.lit("")), "seq").alias("_title"))
    paths = steps.join(titles, ["source", "_id"]).groupBy("source", "seq").agg(F.array_sort(F.collect_list(F.struct("_k", "_title"))).alias("_p"))
    return sections.join(paths.select("source", "seq", F.transform("_p", lambda x: x["_title"]).alias("section_path")), ["source", "seq"])


def _merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by shuffles and sorts.

    Stored targets and lines are small by their files' size and not by what is made of
    them here, so Spark would send a whole side through the driver to every task.
    """
    return left.hint("merge").join(right, on, how)


def _likeable(size: Column, least: Column) -> tuple[Column, Column]:
    """The least and the greatest length of a line that may be like a target of ``size`` characters."""
    return F.ceil(size * least / (2 - least) - 1e-9), F.floor(size * (2 - least) / least + 1e-9)


def line_rooms(targets: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(source, _room)``: a longer line can only begin with one of its document's targets, and that shows within ``_room`` + 1 characters."""
    size = F.length("target")
    return targets.groupBy("source").agg(F.greatest(F.lit(settings.overlap_line), F.max(size), F.max(_likeable(size, F.col("least"))[1])).cast("int").alias("_room"))


def page_lines(pages: DataFrame, targets: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(source, page, line)``: a page's lines, and each with the next one, as heading keys.

    Keys are cut after as many characters as their document's targets may tell
    apart. A line that is longer is not read with the next one, as both begin alike.
    """
    # under names of their own, as both sides of later joins may come from one table
    held = pages.select(F.col("source").alias("source"), F.col("page").alias("page"), F.filter(F.transform(t.lines_of(F.col("text")), t.strip), lambda x: x != "").alias("_lines"))
    held = _merged(held, line_rooms(targets, settings), ["source"])

    def every(keys: Column) -> Column:
        last = F.sequence(F.lit(0), F.size(keys) - 2)
        paired = F.when(F.size(keys) > 1, F.filter(last, lambda k: F.length(F.get(keys, k)) <= F.col("_room"))).otherwise(F.array().cast("array<int>"))
        both = F.transform(paired, lambda k: t.heading_key(F.concat(F.get("_lines", k), F.lit(" "), F.get("_lines", k + 1))))
        return F.array_distinct(F.transform(F.concat(keys, both), lambda key: F.substring(key, F.lit(1), F.col("_room") + 1)))

    # as one expression: a test on a named array would have it computed again
    return held.select("source", "page", F.explode(t.let(F.transform("_lines", t.heading_key), every)).alias("line"))


def _words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def _as_prefix(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """A line that begins with a target of ten characters or more, which ends there or at a blank.

    A line's beginnings up to its document's longest target are looked up by hash.
    """
    longest = targets.groupBy("source").agg(F.max(F.length("target")).alias("_longest"))
    ends = t.let(F.length("line"), lambda n: F.filter(F.sequence(F.lit(10), F.greatest(F.lit(10), F.least(n, "_longest"))), lambda p: (p == n) | (F.substring("line", p + 1, F.lit(1)) == " ")))
    begun = _merged(lines, longest, ["source"]).where(F.length("line") >= 10).select("source", "line", F.explode(F.transform(ends, lambda p: F.xxhash64(F.substring(F.col("line"), F.lit(1), p)))).alias("_hash"))
    found = _merged(begun, targets.where(F.length("target") >= 10).withColumn("_hash", F.xxhash64("target")), ["source", "_hash"])
    return found.where(F.col("line").startswith(F.col("target"))).select("source", "line", "seq")


def _by_words(lines: DataFrame, targets: DataFrame, s: Settings) -> DataFrame:
    """A short line, no sentence, that has most of a target's words.

    A target's words are looked up from the rarest of its document on, and only as
    many as must hold one of the shared ones; what meets is counted in whole.
    """
    short = lines.where((F.length("line") <= s.overlap_line) & ~F.col("line").endswith(".")).withColumn("_held", F.array_distinct(_words(F.col("line"))))
    words = short.select("source", "line", "_held", F.explode("_held").alias("word"))
    often = words.groupBy("source", "word").agg(F.count("*").alias("_often"))
    wanted = targets.withColumn("_list", _words(F.col("target"))).withColumn("_wanted", F.array_distinct("_list")).where(F.size("_wanted") > 0)
    asked = _merged(wanted.select("source", "seq", "target", "_list", "_wanted", F.explode("_wanted").alias("word")), often, ["source", "word"], "left")
    w = Window.partitionBy("source", "seq", "target").orderBy(F.coalesce("_often", F.lit(0)), "word")
    enough = F.size("_wanted") - F.ceil(F.size("_wanted") * s.overlap) + 1
    asked = asked.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= enough).select("source", "seq", "_list", "_wanted", "word")
    met = _merged(words, asked, ["source", "word"])
    many = F.size(F.array_intersect("_held", "_wanted")) >= s.overlap * F.size("_wanted")
    return met.where(F.when(F.size("_list") == 1, F.length("line") <= s.one_word_line).otherwise(many)).select("source", "line", "seq")


def _by_likeness(lines: DataFrame, targets: DataFrame, s: Settings) -> DataFrame:
    """A line like a target; only lines of a length that may be, and letters that may be, are compared."""
    sized = targets.withColumn("_size", F.length("target")).where("_size > 0")
    low, high = _likeable(F.col("_size"), F.col("least"))
    banded = sized.select("source", "seq", "target", "least", F.explode(F.sequence(F.greatest(low, F.lit(1)).cast("int"), F.greatest(high, F.lit(1)).cast("int"))).alias("_length"))
    pairs = _merged(lines.withColumn("_length", F.length("line")), banded, ["source", "_length"]).select("source", "line", "seq", "target", "least")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = SequenceMatcher(None)
        for batch in batches:
            kept, last = [], None
            for line, target, least in zip(*(batch.column(c).to_pylist() for c in (1, 3, 4))):
                if target != last:  # the matcher prepares its second string
                    matcher.set_seq2(target)
                    last = target
                matcher.set_seq1(line)
                kept.append(matcher.quick_ratio() >= least and matcher.ratio() >= least)
            yield batch.filter(pa.array(kept, pa.bool_())).select([0, 1, 2])

    return pairs.mapInArrow(compare, pairs.select("source", "line", "seq").schema)


def heading_hits(targets: DataFrame, lines: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``targets(source, seq, target, least)``, ``lines(source, page, line)`` -> ``(source, seq, page)``.

    Which pages hold which headings: as they are, as a line's beginning, by words
    or by likeness. A document's equal lines are looked at once.
    """
    own = lines.select("source", "line").distinct()
    exact = _merged(own, targets.withColumnRenamed("target", "line"), ["source", "line"]).select("source", "line", "seq")
    met = exact.unionByName(_as_prefix(own, targets)).unionByName(_by_words(own, targets, settings)).unionByName(_by_likeness(own, targets, settings)).distinct()
    return _merged(lines, met, ["source", "line"]).select("source", "seq", "page").distinct()


def _walked(hits: list[list[int]], n_pages: int, most: int) -> list[tuple[int | None, int | None]]:
    """(page's place, pages tried if it was skipped) of each heading, by one cursor that never goes back."""
    out: list[tuple[int | None, int | None]] = []
    at = 0
    for own in hits:
        k = bisect_left(own, at)
        if at >= n_pages:
            out.append((None, None))
        elif k < len(own) and own[k] < at + most:
            at = own[k]
            out.append((at, None))
        elif at + most <= n_pages:
            at += most - 1  # the page of the last miss is the next heading's first
            out.append((None, most))
        else:
            at = n_pages
            out.append((None, None))
    return out


def heading_pages(sections: DataFrame, pages: DataFrame, located: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Sections with ``pdf_page``, and one report row per document.

    Targets and pages are walked with one cursor that never goes back: a hit
    gives the page and tries the next target on the same page, a miss counts a
    page, and after ten misses a target is skipped. Which page holds which target
    is found before, by joins; the cursor gets the places of pages, no text.
    """
    target = t.heading_target(F.col("marker_text"), F.col("id"), F.col("title"))
    wanted = sections.withColumn("_target", target)
    least = F.when(F.length("_target") < settings.short_title, F.lit(settings.fuzzy_short)).otherwise(F.lit(settings.fuzzy_long))
    targets, _ = written(wanted.where("_target <> ''").select("source", "seq", F.explode(t.heading_variants(F.col("_target"))).alias("target"), least.alias("least")), "targets")
    kept = pages.join(located.select("source", "page"), ["source", "page"], "left_anti")
    lines, _ = written(page_lines(kept, targets, settings), "page-lines")
    place = F.row_number().over(Window.partitionBy("source").orderBy("page")) - 1
    places = kept.select(F.col("source").alias("source"), F.col("page").alias("page")).withColumn("_place", place)
    hits = _merged(heading_hits(targets, lines, settings), places, ["source", "page"])
    hits = hits.groupBy("source", "seq").agg(F.array_sort(F.collect_list("_place")).alias("_hits"))
    counts = places.groupBy("source").agg(F.count("*").cast("int").alias("_pages"))
    queue = wanted.select(F.col("source").alias("source"), "seq", (F.col("_target") != "").alias("_asked"))
    queue = _merged(_merged(queue, hits, ["source", "seq"], "left"), counts, ["source"], "left")

    def walk(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("seq", kind="stable")
        asked = own[own["_asked"].fillna(False).astype(bool)]
        n_pages = own["_pages"].iloc[0]
        found = _walked([[] if x is None else list(x) for x in asked["_hits"]], 0 if pd.isna(n_pages) else int(n_pages), settings.pages_per_target)
        out = pd.DataFrame({"source": asked["source"], "seq": asked["seq"], "_place": [a for a, _ in found], "pages_tried": [b for _, b in found]})
        return out.astype({"_place": "Int32", "pages_tried": "Int32"})

    found = queue.groupBy("source").applyInPandas(walk, "source string, seq int, _place int, pages_tried int")
    found = _merged(found, places.withColumnRenamed("page", "pdf_page"), ["source", "_place"], "left").select("source", "seq", "pdf_page", "pages_tried")
    # the walk is read by the sections and by the report
    found, _ = written(found, "heading-pages")
    mapped = _merged(wanted, found, ["source", "seq"], "left")
    in_order = lambda x: F.array_sort(F.collect_list(F.when(x, F.struct("seq", "title", F.col("_target").alias("target_norm"), "pages_tried"))))
    report = mapped.groupBy("source").agg(F.count("*").alias("headings_total"), F.count("pdf_page").alias("headings_found"), in_order(F.col("pdf_page").isNull()).alias("_lost"), in_order(F.col("pages_tried").isNotNull()).alias("headings_skipped"))
    report = report.select("source", "headings_total", "headings_found", F.transform("_lost", lambda x: x["title"]).alias("headings_not_found"), "headings_skipped")
    return mapped.drop("_target", "pages_tried"), report
