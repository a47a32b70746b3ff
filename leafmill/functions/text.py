"""Text expressions: each takes and gives Spark columns, none leaves the JVM.

Java's classes are made Unicode-aware (``(?U)``) and lines end at ``\\n`` only
(``(?d)``), so that white space and word characters agree with Python's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import packs
from ..packs import LanguagePack, Settings

U = "(?dU)"
SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(x: Column, pattern: str) -> Column:
    return x.rlike(U + pattern)


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, f"{U}\\A{SPACE}+|{SPACE}+\\z", "")


def strip_held(x: Column) -> Column:
    """``strip`` of a column or of a value that ``let`` holds: looked at in whole only if white space is at an end."""
    ends = F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
    return F.when(matches(ends, SPACE), strip(x)).otherwise(x)


def has_sign(x: Column) -> Column:
    """Whether anything but white space is there."""
    return x.rlike(f"{U}[^\\s\\x1c-\\x1f]")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, f"{U}{SPACE}+\\z", "")


def single_spaces(x: Column) -> Column:
    return F.regexp_replace(x, f"{U}{SPACE}+", " ")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def any_match(x: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | matches(x, pattern)
    return found


# --- identifiers and keys ---


def slug(text: Column, size: int = 30) -> Column:
    kept = F.regexp_replace(F.lower(text), f"{U}[^\\w\\s]", "")
    return F.regexp_replace(F.substring(F.regexp_replace(kept, f"{U}\\s+", "_"), 1, size), r"\A_+|_+\z", "")


def fold_homoglyphs(text: Column) -> Column:
    return F.translate(text, *packs.HOMOGLYPHS)


def to_latin(text: Column) -> Column:
    out = F.translate(text, *packs.LETTERS)
    for letter, pair in packs.DIGRAPHS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def heading_key(text: Column) -> Column:
    """A heading or line in the form that headings are compared in."""
    out = strip(text)
    for pattern, by in packs.HEADING_CLEAN:
        out = F.regexp_replace(out, U + pattern, by)
    return strip(F.lower(fold_homoglyphs(out)))


def heading_variants(key: Column) -> Column:
    """The key, without a leading marker, without the word for chapter."""
    bare = F.regexp_replace(key, U + packs.HEADING_MARK, "")
    return F.array_distinct(F.filter(F.array(key, bare, F.regexp_replace(key, f"{U}\\A{packs.CHAPTER}\\s+", "")), lambda x: x != ""))


def heading_target(marker_text: Column, id_: Column, title: Column) -> Column:
    """What a section's heading should read, as a heading key."""
    said = lambda x: F.coalesce(x, F.lit("")) != ""
    title = F.coalesce(title, F.lit(""))
    return heading_key(F.when(said(marker_text), F.concat(marker_text, F.lit(" "), title)).when(said(id_), F.concat(id_, F.lit(". "), title)).otherwise(title))


def query_form(query: Column) -> Column:
    """A query in the form that intents are found in."""
    bare = F.regexp_replace(F.lower(strip(query)), r"[?!.,;:]+\z", "")
    return single_spaces(bare)


def query_key(query: Column) -> Column:
    """A query in the form that duplicates are found by."""
    return strip(query_form(query))


# --- sentences ---


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, f"{U}(?<=[.!?])\\s+", -1), strip_held)
    return F.filter(parts, lambda x: x != "")


def sentence_starts(text: Column) -> Column:
    """How many sentences begin after another one on a page."""
    upper = f"[{packs.CYRILLIC_UPPER}A-Z]"
    bare = F.regexp_replace(text, r"\.{2,}", "")
    bare = F.regexp_replace(bare, "(?dUimu)" + packs.LINE_MARK, "")
    return F.size(F.regexp_extract_all(bare, F.lit(f"{U}[.!?]\\s+{upper}"), F.lit(0)))


# --- markers and styles of headings ---


def marker(text: Column) -> Column:
    """``struct<family,id,title,marker_text>`` of a line; nulls without a marker."""

    def found(family: Column, id_: Column, title: Column, head: Column) -> Column:
        return F.struct(family.cast("string").alias("family"), id_.cast("string").alias("id"), title.alias("title"), head.alias("marker_text"))

    none = F.lit(None).cast("string")
    out = F.when(matches(text, packs.MARKER_BULLET), found(F.concat(F.lit("nonAlnum_"), F.regexp_extract(text, U + packs.MARKER_BULLET, 1)), none, strip(F.regexp_extract(text, U + packs.MARKER_BULLET, 2)), F.regexp_extract(text, U + packs.MARKER_BULLET, 1)))
    out = out.otherwise(found(none, none, text, F.lit("")))
    for family, pattern, id_group, title_group in reversed(packs.MARKERS):
        tail = F.regexp_extract(text, U + pattern, title_group)
        head = strip(F.substring(text, F.lit(1), F.length(text) - F.length(tail)))
        out = F.when(matches(text, pattern), found(F.lit(family), F.regexp_extract(text, U + pattern, id_group), strip(tail), head)).otherwise(out)
    return out


def marker_family(text: Column) -> Column:
    """The family of a line's marker alone, or null."""
    out = F.when(matches(text, packs.MARKER_BULLET), F.concat(F.lit("nonAlnum_"), F.regexp_extract(text, U + packs.MARKER_BULLET, 1)))
    for name, pattern, _, _ in reversed(packs.MARKERS):
        out = F.when(matches(text, pattern), F.lit(name)).otherwise(out)
    return out


def has_marker(text: Column) -> Column:
    return any_match(text, [p for _, p, _, _ in packs.MARKERS])


EDGE_SIGNS = r"""[.,;:!?()\[\]"'«»„“]+"""


def all_upper(x: Column) -> Column:
    """Has an upper-case letter and none of another case."""
    return x.rlike(r"\p{Lu}") & ~x.rlike(r"[\p{Ll}\p{Lt}]")


def style(text: Column) -> Column:
    """``upper`` or ``mixed`` for a line that starts like a heading, else null."""

    def judged(bare: Column) -> Column:
        words = F.filter(F.split(bare, f"{U}\\s+", -1), lambda w: w.rlike(r"\p{L}"))
        clean = F.filter(F.transform(words, lambda w: F.regexp_replace(w, f"\\A{EDGE_SIGNS}|{EDGE_SIGNS}\\z", "")), lambda w: F.length(w) >= 2)

        def counted(clean: Column) -> Column:
            upper = F.size(F.filter(clean, all_upper))
            share = F.when(F.size(clean) > 0, upper >= 0.9 * F.size(clean)).otherwise(all_upper(bare))
            return F.when(share, F.lit("upper")).otherwise(F.lit("mixed"))

        return F.when(bare.rlike(r"\A\p{Lu}"), let(clean, counted))

    bare = strip(F.regexp_replace(strip(text), f"{U}{packs.MARKER_PREFIX}", ""))
    return F.when(F.length(strip(text)) >= 3, let(bare, judged))


def family(marker_family: Column, line_style: Column) -> Column:
    """The combined family that levels are told by."""
    marked = F.when(marker_family.isNotNull(), F.concat_ws("_", line_style, marker_family))
    return F.when(line_style == "upper", F.lit("upper")).otherwise(F.coalesce(marked, line_style, F.lit("bez-markera")))


def toc_entry(line: Column) -> Column:
    """``struct<text,page>`` of a contents line: dot leader, or spaces before a number."""
    text = strip(line)
    dots, gap = packs.ENTRY_DOTS, packs.ENTRY_GAP

    def cut(pattern: str) -> Column:
        page = F.regexp_extract(text, U + pattern, 1).try_cast("int")
        return F.struct(rstrip(F.regexp_replace(text, U + pattern, "")).alias("text"), page.alias("page"))

    plain = F.struct(text.alias("text"), F.lit(None).cast("int").alias("page"))
    return F.when(matches(text, dots), cut(dots)).when(matches(text, gap), cut(gap)).otherwise(plain)


# --- predicates ---


def is_title(line: Column, titles: list[str]) -> Column:
    """Whether a line is one of the titles, a colon or stop after it allowed."""
    return F.lower(F.regexp_replace(strip(line), f"{U}\\s*[:.]?\\s*\\z", "")).isin([t.lower() for t in titles])


def is_page_number(line: Column) -> Column:
    return matches(line, r"\A\d{1,3}\z")


def ends_sentence(x: Column) -> Column:
    return x.rlike(r"[.!?]\z")


def is_toc_line(line: Column, settings: Settings = Settings()) -> Column:
    s = strip(line)
    short = (F.length(s) < 120) & ~ends_sentence(s) & ~is_page_number(s)
    return (s != "") & (F.length(s) <= settings.toc_line_chars) & (has_marker(s) | matches(s, packs.MARKER_BULLET) | short)


def is_imprint(text: Column, pack: LanguagePack = LanguagePack()) -> Column:
    upper = F.upper(text)
    found = F.lit(False)
    for mark in pack.imprint_marks:
        found = found | upper.contains(mark)
    return found


def is_summary(title: Column, pack: LanguagePack = LanguagePack()) -> Column:
    found = F.lit(False)
    for phrase in pack.summary_phrases:
        found = found | F.lower(title).contains(phrase)
    return F.coalesce(found, F.lit(False))


def is_level1_title(title: Column) -> Column:
    first = F.substring(title, 1, 40)
    count = lambda kind: F.length(F.regexp_replace(first, f"[^\\p{{{kind}}}]", ""))
    return (count("L") > 0) & (count("Lu") >= 0.7 * count("L"))


def is_reference(text: Column) -> Column:
    """Whether a line reads like a bibliography entry."""
    low, start = F.lower(text), F.substring(text, 1, 150)
    words = F.lit(False)
    for word in packs.REFERENCE_WORDS:
        words = words | low.contains(word)
    dated = F.substring(text, 1, 60).contains(",") & matches(start, packs.REFERENCE_YEAR)
    named = matches(F.substring(text, 1, 80), packs.REFERENCE_NAME)
    return words | matches(low, packs.REFERENCE_ID) | dated | named | matches(start, packs.REFERENCE_ISSUE)


def heading_candidate(line: Column) -> Column:
    """``struct<level,id,title>`` of a line that looks like a heading, else null."""
    s = strip(line)
    out = F.lit(None).cast("struct<level:int,id:string,title:string>")
    for level, pattern in reversed(packs.HEADING_LEVELS):
        title = strip(F.regexp_extract(s, U + pattern, 2))
        fits = matches(s, pattern)
        fits = fits & is_level1_title(title) if level == 1 else fits
        out = F.when(fits, F.struct(F.lit(level).alias("level"), F.regexp_extract(s, U + pattern, 1).alias("id"), title.alias("title"))).otherwise(out)
    return F.when(~s.rlike(r"\.{4,}") & (F.length(s) <= 120), out)


def is_sentence_line(line: Column) -> Column:
    s = strip(line)
    bare = F.regexp_replace(s, rf"(?dUiu)\b({'|'.join(packs.ABBREVIATIONS)})\.", "")
    return (F.length(s) >= 50) & s.rlike(r"""\A[\p{Lu}\p{Nd}„«("']""") & bare.rlike("[.!?]")


def without(x: Column, own: Column) -> Column:
    """An array without any element equal to ``own`` (a null takes nothing out)."""
    return F.when(own.isNull(), x).otherwise(F.array_remove(x, own))


def packed(parts: Column, target: int = 700, least: int = 200) -> Column:
    """Sentences joined greedily to pieces of about ``target`` characters.

    A sentence that would pass the target starts a new piece if the current one
    has at least ``least`` characters, and else still joins it and closes it.
    The first sentence of a piece counts one character more unless it started
    the piece by passing the target.
    """
    return let(parts, lambda held: _packed(held, target, least))


def _packed(parts: Column, target: int, least: int) -> Column:
    none = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(0).alias("n"))
    state = lambda ends, at, size, n: F.struct(ends.alias("ends"), at.cast("int").alias("at"), size.cast("int").alias("size"), n.cast("int").alias("n"))

    def step(held: Column, size: Column) -> Column:
        # where pieces end, by numbers of sentences; no text is joined on the way
        at = held["at"] + 1
        over = (held["n"] > 0) & (held["size"] + size + 1 > target)
        fresh = state(F.array_append(held["ends"], held["at"]), at, size, F.lit(1))
        closed = state(F.array_append(held["ends"], at), at, F.lit(0), F.lit(0))
        more = state(held["ends"], at, held["size"] + size + 1, held["n"] + 1)
        return F.when(~over, more).when(held["size"] >= least, fresh).otherwise(closed)

    def cut(ends: Column) -> Column:
        begin = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0))
        return F.transform(ends, lambda end, k: F.array_join(F.slice(parts, begin(k) + 1, end - begin(k)), " "))

    ends = F.aggregate(F.transform(parts, F.length), none, step, lambda held: F.when(held["n"] > 0, F.array_append(held["ends"], held["at"])).otherwise(held["ends"]))
    return let(ends, cut)
