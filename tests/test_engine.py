"""Operators on small hand-written inputs; sentences are our own."""

from __future__ import annotations

import json
import os
import random
import shutil
import subprocess
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from threading import Thread

import pytest
from pyspark.sql import functions as F

from leafmill import cli, packs, schemas
from leafmill.functions import text as t
from leafmill.operators import chunks, entities, pages, questions, retrieval, runs, sections, stats, structure, toc
from leafmill.packs import LanguagePack, Settings, guideline_pack
from leafmill.plans import build
from leafmill.sources import models, readers, writers


def each(spark, values, make):
    """The expression's value for each string."""
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r.y for r in df.select("k", make(F.col("x")).alias("y")).orderBy("k").collect()]


# --- text ---


def test_strip_and_slug(spark):
    assert each(spark, ["\x1c a b \n", "", "　"], t.strip) == ["a b", "", ""]
    assert each(spark, ["I. Лечење, основно!", "a  b\tc", "x" * 40, "abcdefghijklmnopqrstuvwxyz abc def"], t.slug) == ["i_лечење_основно", "a_b_c", "x" * 30, "abcdefghijklmnopqrstuvwxyz_abc"]


def test_heading_keys(spark):
    assert each(spark, ["## I. Chapter ..... 12", "1. A  title:", "Сорај", "a. b"], t.heading_key) == ["i chapter", "1 a title", "copaj", "a b"]
    assert each(spark, ["i title", "12 title", "title"], t.heading_variants) == [["i title", "title"], ["12 title", "title"], ["title"]]


def test_latin_and_homoglyphs(spark):
    assert each(spark, ["Његова љубав и џем, Ђурђа", "latin"], t.to_latin) == ["Njegova ljubav i džem, Đurđa", "latin"]
    assert each(spark, ["сорај"], t.fold_homoglyphs) == ["copaj"]


def test_query_forms(spark):
    assert each(spark, [" What  IS it ?!", "a ?"], t.query_form) == ["what is it ", "a "]
    assert each(spark, ["a ?", "?!"], t.query_key) == ["a", ""]


def test_markers(spark):
    lines = ["1.2.3 Deep", "1.2. Mid", "XII Not roman", "IV. Roman", "7. One", "Б. Upper", "б. lower", "ПОГЛАВЉЕ 3. Title", "• item", "plain"]
    found = each(spark, lines, t.marker)
    assert [r.family for r in found] == ["arapski-3", "arapski-2", None, "rimski", "arapski-1", "veliko", "malo", "poglavlje", "nonAlnum_•", None]
    assert [r.id for r in found][:2] == ["1.2.3", "1.2"] and found[7].id == "3" and found[7].marker_text == "ПОГЛАВЉЕ 3."
    assert found[4].title == "One" and found[9].title == "plain" and found[9].marker_text == ""


def test_styles_and_families(spark):
    lines = ["1. ALL UPPER 2", "1. Mixed Words", "lower start", "AB", "A B C", "I. ČETIRI"]
    assert each(spark, lines, t.style) == ["upper", "mixed", None, None, "upper", "upper"]
    df = spark.createDataFrame([("rimski", "upper"), ("malo", "mixed"), (None, "mixed"), ("malo", None), (None, None)], "m string, s string")
    assert [r.f for r in df.select(t.family(F.col("m"), F.col("s")).alias("f")).collect()] == ["upper", "mixed_malo", "mixed", "malo", "bez-markera"]


def test_toc_entries(spark):
    got = each(spark, ["Title ..... 12", "Title .....", "Title   7", "Title   12345", " Title 7 "], t.toc_entry)
    assert [(r.text, r.page) for r in got] == [("Title", 12), ("Title", None), ("Title", 7), ("Title   12345", None), ("Title 7", None)]


def test_predicates(spark):
    assert each(spark, ["Contents:", "  САДРЖАЈ ", "Contents of it"], lambda x: t.is_title(x, packs.CONTENTS_TITLES)) == [True, True, False]
    assert each(spark, ["Smith J. and others", "see doi:10", "A, B 1999 text", "Plain heading"], t.is_reference) == [True, True, True, False]
    long = "This sentence has certainly more than fifty letters in it."
    assert each(spark, [long, long[:-1], "lower " + long, "Ovo je jedan duži red teksta sa skraćenicom npr. bez kraja"], t.is_sentence_line) == [True, False, False, False]
    heads = each(spark, ["I. UPPER CASE TITLE", "I. Lower case title", "2. Second", "a. Third", "2. Dots .... 5"], t.heading_candidate)
    assert [r and r.level for r in heads] == [1, None, 2, 3, None]


def packed_rule(parts, target=700, least=200):
    out, now, size = [], [], 0
    for part in parts:
        if now and size + len(part) + 1 > target:
            if size >= least:
                out.append(" ".join(now))
                now, size = [part], len(part)
            else:
                out.append(" ".join([*now, part]))
                now, size = [], 0
        else:
            now.append(part)
            size += len(part) + 1
    return out + ([" ".join(now)] if now else [])


def test_packing(spark):
    rng = random.Random(0)
    cases = [["x" * rng.choice([1, 50, 150, 199, 300, 499, 700, 900]) for _ in range(rng.randrange(0, 12))] for _ in range(200)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, parts array<string>")
    got = {r.k: r.p for r in df.select("k", t.packed(F.col("parts")).alias("p")).collect()}
    assert all(got[k] == packed_rule(c) for k, c in enumerate(cases))


# --- pages, contents ---


def test_file_names(spark):
    names = ["a_toc_12.pdf", "b_TOC_10-12.PDF", "c_toc_5-3.pdf", "d.pdf", "e.pdf.pdf"]
    assert each(spark, names, pages.named_toc_pages) == [[12], [10, 11, 12], [], None, None]
    assert each(spark, names, pages.stem) == ["a", "b", "c", "d", "e"]
    files = spark.createDataFrame([(n,) for n in [*names, "a.pdf"]], "file_name string")
    pack = LanguagePack(toc_locations={"c": [1], "d": [2, 3]})
    got = {r.source: r.toc_pages for r in pages.explicit_toc_pages(files.where("file_name <> 'a.pdf'"), pack).collect()}
    assert got == {"a": [12], "b": [10, 11, 12], "c": [1], "d": [2, 3], "e": None}
    assert {r.file_name for r in pages.latest_files(files).collect()} == {"a_toc_12.pdf", "b_TOC_10-12.PDF", "c_toc_5-3.pdf", "d.pdf", "e.pdf.pdf"}


def test_page_cleaning(spark):
    raw = spark.createDataFrame([("s", 1, " " + "a" * 99 + " "), ("s", 2, "b" * 50 + "  \n" + "c" * 49), ("s", 3, None)], "source string, page int, text string")
    assert [(r.page, r.n_chars) for r in pages.clean_pages(raw).collect()] == [(2, 100)]


def toc_page(n):
    return "\n".join(["Contents", *(f"{k}. Part {k} ..... {k}" for k in range(1, n))])


def test_finding_contents(spark):
    prose = "One sentence stands here and it is long. Another one follows it now. And a third one."
    book = [("s", p, toc_page(8) if p in (2, 3) else prose) for p in range(1, 31)]
    late = [("t", p, toc_page(8) if p == 24 else prose) for p in range(1, 31)]
    none = [("u", p, prose) for p in range(1, 31)]
    named = [("v", p, prose) for p in range(1, 31)]
    held = spark.createDataFrame(book + late + none + named, "source string, page int, text string")
    explicit = spark.createDataFrame([("v", [5, 6]), ("u", [99])], "source string, toc_pages array<int>")
    got = {(r.source, r.page): r.toc_location for r in toc.toc_pages(toc.page_flags(held), explicit).collect()}
    assert got == {("s", 2): "front", ("s", 3): "front", ("t", 24): "back", ("v", 5): "explicit", ("v", 6): "explicit"}
    entries, located = toc.parse_toc(held, explicit)
    docs = {r.source: r for r in toc.toc_documents(held, located, entries).collect()}
    assert docs["s"].toc_pages == [2, 3] and docs["u"].warning and docs["u"].toc_location == "not-found"
    rows = [r for r in entries.where("source = 's'").orderBy("seq").collect()]
    assert [(r.id, r.title, r.printed_page) for r in rows[:2]] == [("1", "Part 1", 1), ("2", "Part 2", 2)]


def test_merging_lines(spark):
    lines = ["I. FIRST PART", "GOES ON", "II. SECOND", "third starts,", "Then more", "closed.", "Next"]
    df = spark.createDataFrame([("s", k + 1, x, k, 1) for k, x in enumerate(lines)], "source string, seq int, text string, printed_page int, pdf_page int")
    got = [(r.text, r.printed_page) for r in toc.merged_lines(df).orderBy("seq").collect()]
    assert got == [("I. FIRST PART GOES ON", 1), ("II. SECOND third starts, Then more closed.", 5), ("Next", 6)]


def test_levels_by_first_appearance(spark):
    df = spark.createDataFrame([("s", k, f) for k, f in enumerate("abacb")], "source string, seq int, family string")
    assert [r.level for r in toc.family_levels(df).orderBy("seq").collect()] == [1, 2, 1, 3, 2]


# --- sections ---


def section_rows(spark, rows):
    return spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], "source string, seq int, id string, title string, level int, pdf_page int, marker_text string")


def test_section_ids(spark):
    rows = [("I", "One", 1, 1, "I."), ("1", "A", 2, 1, ""), (None, "Some Title", 3, 2, ""), ("1", "B", 2, 3, ""), (None, "?!", 1, 4, "")]
    got = sections.section_paths(sections.siblings(sections.section_ids(section_rows(spark, rows)))).orderBy("seq").collect()
    assert [r.section_ids[-1] for r in got] == ["d::I", "d::I.1", "d::I.1.some_title", "d::I.1", "d::S4"]
    assert [r.parent_section_id for r in got] == [None, "d::I", "d::I.1", "d::I", None]
    assert got[0].sibling_sections == ["d::S4"] and got[1].sibling_sections == []
    assert got[2].section_path == ["One", "A", "Some Title"] and got[3].section_path == ["One", "A"]


def test_ancestors_agree_with_a_stack(spark):
    rng = random.Random(4)
    levels = [rng.randrange(1, 5) for _ in range(60)]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(levels)], "source string, seq bigint, level int")
    got = [r.parent_seq for r in sections.ancestors(df, ["source"]).orderBy("seq").collect()]
    stack, want = [], []
    for k, x in enumerate(levels):
        while stack and stack[-1][1] >= x:
            stack.pop()
        want.append(stack[-1][0] if stack else None)
        stack.append((k, x))
    assert got == want


def test_heading_pages(spark):
    body = [("d", 1, "I. Opening words\nx"), ("d", 2, "2. A second\nheading of two lines\nPrefixed heading text goes on here"), ("d", 3, "nothing"), ("d", 4, "alpha beta gamma delta")]
    rows = [("I", "Opening words", 1, None, "I."), ("2", "A second heading of two lines", 2, None, "2."), (None, "Prefixed heading text", 2, None, ""), (None, "alpha beta gamma zeta", 2, None, ""), (None, "Never there", 2, None, "")]
    located = spark.createDataFrame([], "source string, page int")
    held = spark.createDataFrame(body, "source string, page int, text string")
    found, report = sections.heading_pages(section_rows(spark, rows).drop("pdf_page"), held, located)
    assert [r.pdf_page for r in found.orderBy("seq").collect()] == [1, 2, 2, 4, None]
    r = report.first()
    assert (r.headings_total, r.headings_found, r.headings_not_found, r.headings_skipped) == (5, 4, ["Never there"], [])


def test_skipping_targets(spark):
    rows = [(None, "Missing heading one", 1, None, ""), (None, "Present heading", 1, None, "")]
    held = spark.createDataFrame([("d", p, "Present heading" if p == 10 else "zzz") for p in range(1, 13)], "source string, page int, text string")
    nowhere = spark.createDataFrame([("d", 99)], "source string, page int")
    found, report = sections.heading_pages(section_rows(spark, rows).drop("pdf_page"), held, nowhere)
    assert [r.pdf_page for r in found.orderBy("seq").collect()] == [None, 10]
    assert report.first().headings_skipped[0].pages_tried == 10


# --- chunks ---

SECTION = """3
Intro sentence here. Another one.
Препорука 1.1
Short advice.
Табела 2. A table
cell one
cell two
II. Next part
• first
• second

• alone
Препорука 9.3
""" + "\n".join(["Head of a long recommendation. " + "w" * 400, "1. item one", "more of one", "– item two " + "v" * 400, "Литература", "tail."])


def test_document_chunks(spark):
    rows = [("I", "First", 1, 1, "I."), ("1", "Same page", 2, 1, ""), ("2", "Zbirni pregled", 1, 2, "")]
    held = spark.createDataFrame([("d", 1, SECTION), ("d", 2, "Препорука 10.1\nText.")], "source string, page int, text string")
    got = chunks.document_chunks(section_rows(spark, rows), held).orderBy("seq", "kind_rank", "item_seq").collect()
    by = {r.chunk_id: r for r in got}
    assert [r.chunk_type for r in got] == ["recommendation"] * 4 + ["table", "list_item", "paragraph", "recommendation"]
    assert by["d::d::I.1::p1::rec::1.1::c0"].text == "Препорука 1.1\nShort advice."
    parts = [r.text for r in got if r.recommendation_id == "9.3"]
    assert [p[:8] for p in parts] == ["Препорук", "1. item ", "– item t"] and parts[1] == "1. item one\nmore of one"
    assert by["d::d::I.1::p1::tbl::2"].table_title == "A table" and by["d::d::I.1::p1::tbl::2"].text.endswith("cell two")
    assert by["d::d::I.1::p1::list::1::whole"].text == "• first\n• second"
    assert by["d::d::I.1::p1::p::c0"].text.startswith("Intro sentence here. Another one.") and "Литература" in by["d::d::I.1::p1::p::c0"].text
    assert by["d::d::I.1::p1::tbl::2"].related_recommendations == ["1.1", "9.3"] and by["d::d::I.1::p1::rec::1.1::c0"].related_recommendations == ["9.3"]
    assert by["d::d::2::p2::rec::10.1::c0"].is_summary and by["d::d::2::p2::rec::10.1::c0"].related_recommendations == []


def test_long_lists(spark):
    items = "\n".join(f"• item {k} " + "x" * 100 for k in range(5))
    held = spark.createDataFrame([("d", 1, items)], "source string, page int, text string")
    got = chunks.document_chunks(section_rows(spark, [("I", "T", 1, 1, "")]), held).orderBy("item_seq").collect()
    assert [(r.list_index, r.list_total, r.chunk_id[-5:]) for r in got] == [(k, 5, f"item{k}") for k in range(5)]


def test_structure(spark):
    body = "Ovo je jedna sasvim obična i dovoljno duga rečenica teksta koja stoji ispod."
    first = ["12", "I. VELIKI NASLOV", body, "Препорука 3.1", "advice line", "2. Inside a list", "more advice", "Литература", "outside", "2. Naslov drugi", body, "3. Short body", "I. SMITH J. et al", body]
    held = spark.createDataFrame([("d", 1, "\n".join(first)), ("d", 2, "Препорука 4.1\nlast")], "source string, page int, text string")
    found, recs = structure.parse_structure(held)
    assert [(r.id, r.title, r.level, r.page) for r in found.orderBy("seq").collect()] == [("I", "VELIKI NASLOV", 1, 1), ("2", "Naslov drugi", 2, 1), ("3", "Short body", 2, 1)]
    assert [(r.id, r.section_id, r.text) for r in recs.orderBy("line_no").collect()] == [("3.1", "3", "advice line\nmore advice"), ("4.1", "3", "last")]


# --- runs ---


def test_look_ahead_counts_rows(spark):
    for gap, want in ((8, True), (9, False)):
        df = spark.createDataFrame([("g", k, k == gap) for k in range(12)], "g string, n int, hit boolean")
        got = runs.leads_before(df, ["g"], ["n"], F.col("hit"), F.lit(False), 8, "leads").where("n = 0").first()
        assert got.leads is want


# --- entities, questions ---


def test_json_repair(spark):
    answers = ['```json\n{"drug": ["A ", 3, "a", ""], "dose": "x", "zzz": ["q"]}\n```', 'said {"test": ["T"]} so', "no json", "{broken", None]
    got = each(spark, answers, lambda x: entities.valid_entities(entities.repaired_json(x), ["drug", "dose", "test"]))
    assert got == [{"drug": ["a"], "dose": [], "test": []}, {"drug": [], "dose": [], "test": ["t"]}] + [{"drug": [], "dose": [], "test": []}] * 3


def test_normalising(spark):
    pack = guideline_pack()
    held = {"disease": ["Астма ", "asthma", "COPD", "boljes", "salbutamol", "x" * 101, "a", " "], "comorbidity": ["atrijalna fibrilacija", "Anxiety"]}
    records = spark.createDataFrame([("c1", held), ("c2", {"drug": ["astma"]}), ("c3", {})], "chunk_id string, entities map<string,array<string>>")
    got = {r.chunk_id: r.entities for r in entities.normalised_entities(records, pack).collect()}
    assert got == {"c1": {"disease": ["astma", "bolest", "hobp"], "comorbidity": ["anksioznost", "atrijalna fibrilacija"]}, "c2": {}, "c3": {}}
    assert len(pack.known_terms) == len(set(pack.known_terms)) and len(pack.translations) == 93


def test_questions(spark):
    records = spark.createDataFrame([("c", "s", 1, ["p"], ["i"], {"drug": ["aa", "bb", "cc", "dd"], "dose": ["10", "20"], "x": []})], "chunk_id string, source string, pdf_page int, section_path array<string>, section_ids array<string>, entities map<string,array<string>>")
    forms = [(1, "t1", "Give {drug} at {dose}?", "dosage", ["drug", "dose"]), (2, "t2", "No {x} now?", "precise", ["x"]), (3, "t3", "{drug}", "precise", ["drug"]), (4, "t4", "Only {drug} works here", "precise", ["drug"])]
    templates = spark.createDataFrame(forms, "seq int, id string, template string, intent string, requires array<string>")
    got = questions.generated(records, templates).orderBy("question_no").collect()
    assert [r.query for r in got] == ["Give aa at 10?", "Give aa at 20?", "Give bb at 10?", "Give bb at 20?", "Give cc at 10?", "Only aa works here", "Only bb works here", "Only cc works here"]
    assert got[1].entities == {"drug": "aa", "dose": "20"}


def test_values_with_braces_are_not_filled_again(spark):
    df = spark.createDataFrame([("{a} and {b}, {c}", {"a": "{b}", "b": "x $1 \\\\"})], "t string, v map<string,string>")
    assert df.select(questions.filled(F.col("t"), F.col("v")).alias("q")).first().q == "{b} and x $1 \\\\, {c}"


def test_reports(spark):
    chunk = spark.createDataFrame([("s", "c1"), ("s", "c2"), ("u", "c3")], "source string, chunk_id string")
    rows = spark.createDataFrame([("s", "t1", "i"), ("s", "t1", "i"), ("s", "t2", None)], "source string, template_id string, intent string")
    got = {r.source: (r.n_chunks, r.n_raw, r.n_final, r.n_removed, r.by_template) for r in questions.instance_stats(chunk, rows, rows.where("intent is not null")).collect()}
    assert got == {"s": (2, 3, 2, 1, {"t1": 2}), "u": (1, 0, 0, 0, {})}
    told = sorted((r.dimension, r["rank"], r.value, r.n) for r in questions.question_report(rows, 1).collect())
    assert told == [("intent", 1, "i", 2), ("source", 1, "s", 3), ("template_id", 1, "t1", 2)]
    before = spark.createDataFrame([({"a": ["x", "y" * 101], "b": []},), ({"a": []},)], "entities map<string,array<string>>")
    after = spark.createDataFrame([({"a": ["x"]},), ({},)], "entities map<string,array<string>>")
    r = entities.entity_stats(before, after).first()
    assert (r.chunks_before, r.with_entities_before, r.terms_before, r.too_long_before, r.terms_after, r.too_long_after, r.reduction) == (2, 1, 2, 1, 1, 0, 50.0)
    assert stats.cut("a\nb" * 3, 4) == "a ba..." and stats.cut("ab", 4) == "ab"


def test_links_of_a_section(spark):
    """Recommendations and tables of the chapter, lists of the section; summaries have the last only."""
    rows = [("a", ["1"], False, "9.1", None, None), ("b", ["1", "1.1"], False, "9.2", "T1", "l1"), ("c", ["1", "1.1"], False, None, "T2", "l2"), ("d", ["1", "1.1"], True, "9.3", None, "l3"), ("e", ["2"], False, "9.9", None, "l1")]
    df = spark.createDataFrame(rows, "chunk_id string, section_ids array<string>, is_summary boolean, recommendation_id string, table_id string, list_id string")
    got = {r.chunk_id: (r.related_recommendations, r.related_tables, r.related_lists) for r in chunks.related(df).collect()}
    assert got == {"a": (["9.2"], ["T1", "T2"], []), "b": (["9.1"], ["T2"], ["l2", "l3"]), "c": (["9.1", "9.2"], ["T1"], ["l1", "l3"]), "d": ([], [], ["l1", "l2"]), "e": ([], [], [])}


def test_page_tests_of_contents(spark):
    """Imprint, untitled, continued and weak pages."""
    entries = "\n".join(f"{k}. Deo {k}" if k % 2 else f"{k}.1 Odeljak {k}" for k in range(1, 9))
    weak = "\n".join(["Naslov ...... 3", "Drugi ...... 4", "i jedan red"])
    plain = "\n".join(f"Naslov bez broja {k}" for k in range(45))
    texts = [entries, entries + "\nISBN 1", "1. Deo jedan\nnastavak", weak, plain, plain + "\nКраj. А sledi. B sledi. V sledi.", "jedna rečenica koja nije naslov, već dugačak tekst. " * 4, ""]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(texts)], "source string, page int, text string")
    got = {r.page: (r.is_titled, r.is_untitled, r.is_continued, r.is_fallback, r.imprint) for r in toc.page_flags(df).collect()}
    assert got[0] == (False, True, True, False, False) and got[1] == (False, False, False, False, True)
    assert got[2][2] and not got[2][1] and got[3][3] and got[4][3] and not got[5][3]
    assert got[6] == got[7] == (False,) * 5


def test_hierarchy(spark):
    levels = [2, 1, 2, 3, 3, 2, 1, 9]
    df = spark.createDataFrame([("s", k, str(k), f"T{k}", x, k) for k, x in enumerate(levels)], "source string, seq int, id string, title string, level int, page int")
    r = structure.hierarchy(df).first()
    shape = lambda nodes: [(int(n["id"]), shape(n["children"])) for n in nodes]
    assert r.n_sections == 8 and shape(json.loads(r.sections)) == [(0, []), (1, [(2, [(3, []), (4, [])]), (5, [])]), (6, [(7, [])])]


def test_any_number_of_levels(spark):
    df = spark.createDataFrame([("s", k, k) for k in range(150)], "source string, seq bigint, level int")
    assert [r.parent_seq for r in sections.ancestors(df, ["source"]).orderBy("seq").collect()] == [None, *range(149)]


def test_dedupe_keeps_the_first_place(spark):
    df = spark.createDataFrame([("s", 1, "A?", 1), ("s", 2, "b", 1), ("s", 3, "a", 2), ("s", 4, "B", 1), ("s", 5, "?", 9)], "source string, n int, query string, size int")
    got = questions.deduplicated(df, ["n"], ["source"], F.col("size")).orderBy("_first.n").collect()
    assert [(r._first.n, r.n) for r in got] == [(1, 3), (2, 2)]


def test_intents(spark):
    pack = LanguagePack(intents=["dosage", "diagnostic", "definitional", "precise"], intent_keywords={"dosage": ["doza"], "diagnostic": ["fev1"], "definitional": ["šta znači"]})
    asked = ["Šta znači FEV1?", "koja je DOZA i fev1", "predoziranje i dozama", "nothing"]
    assert each(spark, asked, lambda x: retrieval.intent(x, pack)) == ["diagnostic", "dosage", "dosage", "precise"]
    assert each(spark, asked, lambda x: retrieval.intent(x, pack, word_bounds=True)) == ["diagnostic", "dosage", "precise", "precise"]


def test_guideline_intents(spark):
    """Our own questions under the shipped keyword lists; the first intent in order wins."""
    pack = guideline_pack()
    assert list(pack.intent_keywords) == pack.intents == packs.INTENTS and sum(map(len, pack.intent_keywords.values())) == 386
    asked = {
        "Može li se emfizem izlečiti?": "curability", "Koja je dnevna doza prednizona?": "dosage", "Koji su prvi simptomi upale pluća?": "symptoms",
        "Kako se sprečava pogoršanje?": "prevention", "Šta dovodi do gušenja?": "risk_factors", "Navedi mere nege": "comprehensive", "Na kojoj strani je citat?": "reference",
        "Koji je redosled radnji?": "procedural", "Da li je sprej bolji ili prah?": "comparison", "Zašto dolazi do gušenja?": "causal", "Čime se leči bronhitis?": "therapeutic",
        "Kako se dijagnostikuje astma?": "diagnostic", "Objasni hiperinflaciju": "definitional", "Šta je spirometar?": "precise", "Emfizem": "precise",
    }
    got = each(spark, list(asked), lambda x: F.struct(retrieval.intent(x, pack).alias("i"), retrieval.is_comprehensive(x, pack).alias("c")))
    assert [r.i for r in got] == list(asked.values()) and [r.c for r in got] == [x == "comprehensive" for x in asked.values()]


def test_sections_suit_intents(spark):
    df = spark.createDataFrame([(["Uvod", "Terapija"], "dosage"), (["Терапија"], "dosage"), (["x"], "precise"), (["x"], "dosage")], "p array<string>, i string")
    told = lambda **k: [r.s for r in df.select(retrieval.section_suits(F.col("p"), F.col("i"), LanguagePack(), **k).alias("s")).collect()]
    assert told() == [True, False, True, False] and told(transliterate=True) == [True, True, True, False]


def test_two_levels(spark):
    unit = lambda x: [x, (1 - x * x) ** 0.5]
    asked = spark.createDataFrame([(1, "i", [1.0, 0.0]), (2, "i", [0.0, 1.0])], "qid bigint, intent string, embedding array<double>")
    stored = spark.createDataFrame([(0, unit(0.95), ["p"], "c1"), (1, unit(0.94), ["p"], "c1"), (2, unit(0.9), ["p"], "c2"), (3, unit(0.5), ["p"], "c3")], "id bigint, embedding array<double>, section_path array<string>, source_chunk string")
    known = spark.createDataFrame([(k, unit(x), ["p"], f"c{k + 1}") for k, x in enumerate((0.1, 0.2, 0.9))], "id bigint, embedding array<double>, section_path array<string>, chunk_id string")
    got = [(r.qid, r.chunk_id, r.level, r.rank) for r in retrieval.retrieve(asked, stored, known).orderBy("qid", "rank").collect()]
    assert got == [(1, "c1", "question", 1), (1, "c2", "question", 2), (2, "c1", "passage", 1), (2, "c2", "passage", 2)]


def test_repeated_chunk_ids_and_fields(spark):
    """The last of passages with one chunk_id answers; questions' own fields come with it."""
    asked = spark.createDataFrame([(1, "i", [1.0, 0.0])], "qid bigint, intent string, embedding array<double>")
    stored = spark.createDataFrame([(0, [1.0, 0.0], ["p"], "c1", "Q?", "t9")], "id bigint, embedding array<double>, section_path array<string>, source_chunk string, query string, template_id string")
    known = spark.createDataFrame([(k, [0.0, 1.0], ["p"], "c1") for k in range(3)], "id bigint, embedding array<double>, section_path array<string>, chunk_id string")
    got = [(r.chunk_id, r.passage_id, r.matched_query, r.template_id) for r in retrieval.retrieve(asked, stored, known).collect()]
    assert got == [("c1", 2, "Q?", "t9")]


def test_ties_at_the_kth_place(spark):
    rows = [(k, [1.0, 0.0]) for k in range(40)] + [(100 + k, [0.0, 1.0]) for k in range(5)]
    index = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid bigint, embedding array<double>")
    got = sorted((r.qid, r["rank"], r.id) for r in retrieval.top_k(asked, index, 6).collect())
    assert got == [(1, k + 1, k) for k in range(6)] + [(2, k + 1, 100 + k) for k in range(5)] + [(2, 6, 0)]


def test_top_k_in_query_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)]
    index = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(5)
    asked = index.where("id < 30").withColumnRenamed("id", "qid")
    whole = {(r.qid, r.rank): r.id for r in retrieval.top_k(asked, index, 7).collect()}
    monkeypatch.setattr(retrieval.cells, "PACK", 11)
    assert {(r.qid, r.rank): r.id for r in retrieval.top_k(asked, index, 7).collect()} == whole
    for q in range(30):
        scores = sorted(((-sum(a * b for a, b in zip(rows[q][1], v)), k) for k, v in rows))[:7]
        assert [whole[q, r + 1] for r in range(7)] == [k for _, k in scores]


# --- sources, builds ---


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "template": "Is {d} so?", "intent": "i", "requires": ["d"]}\n\n{"id": "y", "template": "plain", "intent": "i", "requires": []}\n')
    assert [r.id for r in readers.read_templates(spark, str(tmp_path / "a.jsonl")).orderBy("seq").collect()] == ["x", "y"]
    with pytest.raises(ValueError):
        readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string", strict=True)
    assert {r._source_file for r in readers.read_tagged(spark, str(tmp_path / "*.jsonl"), "id string").collect()} == {"a"}
    (tmp_path / "bad.jsonl").write_text('{"id": "x", "template": "Is {d so?", "intent": "i", "requires": ["d"]}\n')
    with pytest.raises(ValueError):
        readers.read_templates(spark, str(tmp_path / "bad.jsonl"))
    rows = models.embedded(spark.createDataFrame([(k, f"text {k}") for k in range(20)], "k int, text string").repartition(4), models.HashingEncoder)
    writers.write_index(rows, str(tmp_path / "index"), ["k"], "hash", "passage: ")
    back, meta = readers.read_index(spark, str(tmp_path / "index"))
    assert [(r.k, r.embedding_id) for r in back.orderBy("k").collect()] == [(k, k) for k in range(20)]
    assert meta.first().n_rows == 20 and meta.first().dimension == 64


def test_pdf_source(spark, tmp_path):
    for name in ("one_toc_2.pdf", "one.pdf", "two.pdf"):
        (tmp_path / name).write_bytes(f"{name} first|short".encode())
    parser = lambda content: [part * 12 for part in content.decode().split("|")]
    got = {(r.source, r.page): r.text[:7] for r in readers.pdf_pages(spark, str(tmp_path), parser).collect()}
    assert got == {("one", 1): "one_toc", ("two", 1): "two.pdf"}
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        readers.pdf_pages(spark, str(tmp_path / "none"), parser)


def test_one_damaged_pdf_of_ten(spark, tmp_path):
    for k in range(10):
        (tmp_path / f"f{k}.pdf").write_bytes(b"damaged" if k == 3 else b"half" if k == 4 else f"{'page text ' * 20}|short|".encode())

    def parser(content):
        if content == b"damaged":
            raise ValueError("no header")
        if content == b"half":
            yield "whole page " * 20
            raise OSError("broken stream")
        yield from content.decode().split("|")

    kept = readers.pdf_pages(spark, str(tmp_path), parser)
    assert sorted(r.source for r in kept.collect()) == [f"f{k}" for k in range(10) if k != 3]
    told = {r.source: r for r in readers.pdf_report(readers.pdf_rows(spark, str(tmp_path), parser)).collect()}
    assert tuple(told["f0"])[1:] == (3, 1, 1, 1, None)
    assert tuple(told["f3"])[1:] == (0, 0, 0, 0, "ValueError: no header")
    assert tuple(told["f4"])[1:] == (1, 0, 0, 1, "OSError: broken stream")
    assert readers.missing_libraries(["json", "no_such_library"]) == ["no_such_library"]


def test_extraction_and_resume(spark, tmp_path):
    held = spark.createDataFrame([(f"c{k}", "s", 1, ["i"], ["p"], "paragraph", "asthma" if k % 2 else "none") for k in range(6)], "chunk_id string, source string, pdf_page int, section_ids array<string>, section_path array<string>, chunk_type string, text string")

    def client():
        def ask(text):
            if text == "none":
                raise RuntimeError("down")
            return '{"disease": ["Asthma"]}'

        return ask

    got = models.extracted(held, client)
    assert sorted(r.chunk_id for r in got.collect()) == ["c1", "c3", "c5"]
    path = str(tmp_path / "done")
    writers.append_resumed(held.limit(2), lambda x: x, path)
    writers.append_resumed(held, lambda x: x, path)
    assert spark.read.parquet(path).count() == 6


def test_json_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", 2, "dva č"), ("s", 1, None), ("u", 1, "x")], "source string, seq int, title string")
    writers.export_jsonl(rows, str(tmp_path / "lines"))
    back = spark.read.schema("seq int, title string").json(str(tmp_path / "lines" / "source=s"))
    assert sorted(map(tuple, back.collect())) == [(1, None), (2, "dva č")]
    writers.export_documents(rows, str(tmp_path / "docs"))
    held = spark.read.schema("source string, rows array<struct<seq:int,title:string>>").json(str(tmp_path / "docs"))
    assert {r.source: [tuple(x) for x in r.rows] for r in held.collect()} == {"s": [(1, None), (2, "dva č")], "u": [(1, "x")]}
    (tmp_path / "one.json").write_text('{"source": "s",\n "rows": [{"seq": 1,\n "title": "a"}]}')
    assert readers.read_json_document(spark, str(tmp_path / "one.json"), "source string, rows array<struct<seq:int,title:string>>").first().rows[0].title == "a"
    writers.write_by_source(rows, str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by")).where("source = 's'").count() == 2


def test_chat_client(spark):
    """A service of our own on this machine: the prompt, the limits, and failures."""
    said = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            self._answer({"data": []})

        def do_POST(self):
            said.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self._answer({"choices": [{"message": {"content": ' ```json\n{"drug": ["Salbutamol"]}\n``` '}}]})

        def _answer(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    client = models.ChatClient(f"http://127.0.0.1:{server.server_port}/v1", "some-model", ["drug", "dose"])
    assert client.reachable() and client("tekst {sa} zagradama").startswith("```json")
    server.shutdown()
    server.server_close()
    assert not client.reachable()
    assert said[0]["temperature"] == 0.1 and said[0]["max_tokens"] == 2500 and said[0]["messages"][1]["content"].count("- d") == 2
    assert "tekst {sa} zagradama" in said[0]["messages"][1]["content"]


def test_encoders_are_told_apart(spark):
    """Closures of one line that hold different things give different encoders, equal ones share one."""
    rows = spark.createDataFrame([("a b",)], "text string")
    sizes = [models.embedded(rows, lambda n=n: models.HashingEncoder(n)).select(F.size("embedding").alias("n")).first().n for n in (8, 16, 8)]
    assert sizes == [8, 16, 8]


def test_command_line(spark, tmp_path, capsys):
    """The stages from pages to answers, as commands."""
    filler = "Ovo je sasvim obična rečenica o lečenju bolesti. " * 5
    book = [(1, "Contents\n" + "\n".join(f"{k}. Terapija broj {k} ..... {k + 1}" for k in range(1, 7)))] + [(k + 1, f"{k}. Terapija broj {k}\n{filler}\n{filler} Tema{k}.") for k in range(1, 7)]
    spark.createDataFrame([("knjiga", p, x, len(x)) for p, x in book], schemas.PAGE).write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([("knjiga", None)], "source string, toc_pages array<int>").write.parquet(str(tmp_path / "explicit"))
    command = lambda stage, *more: cli.main([stage, str(tmp_path), *more])
    for stage in ("toc", "map", "structure", "chunk", "embed"):
        command(stage)
    found = spark.read.parquet(str(tmp_path / "chunks"))
    assert set(schemas.names(schemas.CHUNK)) <= set(found.columns)
    records = found.limit(1).select(*[c for c in schemas.names(schemas.ENTITY) if c != "entities"], F.create_map(F.lit("disease"), F.array(F.lit("asthma")), F.lit("drug"), F.array(F.lit("salbutamol"))).alias("entities"))
    records.write.parquet(str(tmp_path / "entities"))
    (tmp_path / "forms.jsonl").write_text('{"id": "t", "template": "Da li se {disease} leči sa {drug}?", "intent": "precise", "requires": ["disease", "drug"]}\n')
    command("normalise")
    command("questions", "--input", str(tmp_path / "forms.jsonl"))
    command("embed-questions")
    capsys.readouterr()
    command("retrieve", "--query", "Da li se astma leči sa salbutamol?")
    out = capsys.readouterr().out
    assert "intent: therapeutic" in out and "level:  question" in out and "[t]" in out
    command("retrieve", "--test")
    assert capsys.readouterr().out.count("query:") == len(cli.SAMPLES)


def test_queries_without_the_optional_parts(tmp_path):
    """A copy without the operators for training data and their pipeline still gives its queries."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "leafmill", tmp_path / "leafmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for more in ("corpus_pipeline.py", None):
        if more and (root / more).exists():
            shutil.copy(root / more, tmp_path)
        elif (tmp_path / "corpus_pipeline.py").exists():
            (tmp_path / "corpus_pipeline.py").unlink()
        code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in q))"
        found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
        n, oracles, optional = found.stdout.split()
        assert int(n) >= int(oracles) > 30 and optional == "False"


def test_stream(spark, tmp_path):
    from leafmill.streaming import ingest

    spark.createDataFrame([(k, f"Sentence number {k} is here. " * 60) for k in range(5)], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    query = ingest.append_chunks(ingest.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    want = chunks.paragraph_chunks(spark.read.parquet(str(tmp_path / "in"))).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want > 5


def test_whole_build_and_answer(spark, tmp_path):
    def keep(table, name):
        table.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    filler = "Ovo je sasvim obična rečenica o lečenju bolesti. " * 5
    book = [(1, "Contents\n" + "\n".join(f"{k}. Poglavlje broj {k} ..... {k + 1}" for k in range(1, 7)))] + [(k + 1, f"{k}. Poglavlje broj {k}\n{filler}\n{filler}\n{filler} Tema{k}.") for k in range(1, 7)]
    held = spark.createDataFrame([("knjiga", p, x) for p, x in book], "source string, page int, text string")
    made = keep(build.build_chunks(held, keep=keep), "chunks")
    assert made.count() == 12 and made.select("section_ids").distinct().count() == 6
    passages = models.embedded(made, models.HashingEncoder).withColumn("id", (F.col("seq") * 10 + F.col("item_seq")).cast("long"))
    records = spark.createDataFrame([("knjiga", made.orderBy("seq", "item_seq").first().chunk_id, 2, ["Lečenje i terapija"], ["y"], {"disease": ["asthma"], "drug": ["salbutamol"]})], "source string, chunk_id string, pdf_page int, section_path array<string>, section_ids array<string>, entities map<string,array<string>>")
    templates = spark.createDataFrame([(1, "t", "Da li se {disease} leči sa {drug}?", "precise", ["disease", "drug"])], "seq int, id string, template string, intent string, requires array<string>")
    asked = build.build_questions(records, templates, guideline_pack())
    assert asked.first()["query"] == "Da li se astma leči sa salbutamol?"
    stored = models.embedded(asked, models.HashingEncoder, "query", models.QUERY_PREFIX).withColumn("id", F.lit(0).cast("long"))
    ask = spark.createDataFrame([(1, "Da li se astma leči sa salbutamol?"), (2, "tema3.")], "qid bigint, query string")
    got = build.answer(ask, stored, passages, models.HashingEncoder, guideline_pack(), Settings(passage_score=-1.0)).collect()
    assert {(r.qid, r.level, r.intent, r.template_id) for r in got} == {(1, "question", "therapeutic", "t"), (2, "passage", "precise", None)}
    assert got[0].asDict().keys() == set(schemas.names(schemas.RESULT)) and {r.matched_query for r in got} == {"Da li se astma leči sa salbutamol?", None}
