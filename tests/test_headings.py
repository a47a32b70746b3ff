"""Headings on pages: joins and a cursor over places against a walk over lines."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from leafmill import queries
from leafmill.functions import text as t
from leafmill.operators import sections
from leafmill.packs import Settings

S = Settings()


def slow_place(keys, targets, original):
    cells = [x for pair in keys for x in pair if x]

    def begins(line, target):
        return len(target) >= 10 and line.startswith(target) and line[len(target) : len(target) + 1] in ("", " ")

    def shares(line, target):
        if len(line) > S.overlap_line or line.endswith("."):
            return False
        wanted, held = target.split(), set(line.split())
        if len(wanted) == 1:
            return len(line) <= S.one_word_line and wanted[0] in held
        return bool(wanted) and len(held.intersection(wanted)) >= S.overlap * len(set(wanted))

    least = S.fuzzy_short if len(original) < S.short_title else S.fuzzy_long
    tests = (lambda a, b: a == b, begins, shares, lambda a, b: SequenceMatcher(None, a, b).ratio() >= least)
    return any(test(line, target) for test in tests for line in cells for target in targets)


def slow_walk(queue, pages, place):
    state, at, misses = {k: (None, None) for k, _ in queue}, 0, 0
    for page in pages:
        while at < len(queue):
            if place(page, queue[at]):
                state[queue[at][0]], at, misses = (page, None), at + 1, 0
                continue
            misses += 1
            if misses < S.pages_per_target:
                break
            state[queue[at][0]], at, misses = (None, misses), at + 1, 0
    return state


@pytest.mark.parametrize("seed", range(60))
def test_the_cursor_equals_the_walk(seed):
    rng = random.Random(seed)
    n_pages, n = rng.randint(0, 60), rng.randint(0, 12)
    hits = [sorted(rng.sample(range(n_pages), rng.randint(0, min(n_pages, 3)))) for _ in range(n)]
    want = slow_walk([(k, own) for k, own in enumerate(hits)], range(n_pages), lambda page, x: page in x[1])
    assert sections._walked(hits, n_pages, S.pages_per_target) == [want[k] for k in range(n)]


WORDS = ["plan", "akutna", "astma", "dece", "terapija", "kod", "i", "u", "dijagnoza", "mere", "Увод", "pregled.", "opšta", "2.", "IV", "stanja"]


def changed(rng, title):
    words = title.split()
    kind = rng.randrange(6)
    if kind == 0:
        rng.shuffle(words)
    elif kind == 1 and len(title) > 3:
        at = rng.randrange(len(title))
        return title[:at] + rng.choice("xyz") + title[at + 1 :]
    elif kind == 2:
        words += rng.choices(WORDS, k=rng.randint(1, 12))
    elif kind == 3 and len(words) > 2:
        words.pop(rng.randrange(len(words)))
    elif kind == 4 and len(words) > 1:
        at = rng.randrange(1, len(words))
        return " ".join(words[:at]) + "\n" + " ".join(words[at:])
    return " ".join(words)


def test_hits_and_pages_equal_the_walk_over_lines(spark):
    rng = random.Random(7)
    wanted, body = [], []
    for d in range(6):
        titles = [" ".join(rng.choices(WORDS, k=rng.randint(1, 6))) for _ in range(10)]
        wanted += [(f"d{d}", k, rng.choice([None, "2.", "IV"]), None, x) for k, x in enumerate(titles)] + [(f"d{d}", 10, None, None, "")]
        for page in range(1, 25):
            rows = [changed(rng, rng.choice(titles)) if rng.random() < 0.4 else " ".join(rng.choices(WORDS, k=rng.randint(1, 14))) + rng.choice(["", "."]) for _ in range(rng.randint(0, 6))]
            body.append((f"d{d}", page, "\n".join(["running head", *rows])))
    body.append(("other", 1, "no sections here"))
    entries = spark.createDataFrame(wanted, "source string, seq int, marker_text string, id string, title string")
    pages = spark.createDataFrame(body, "source string, page int, text string")
    located = spark.createDataFrame([("d0", 2), ("d0", 3), ("none", 1)], "source string, page int")
    assert held_against_the_walk(entries, pages, located) > 30


def test_whole_texts_equal_the_walk_over_lines(spark):
    held = queries.as_pages(spark, "/root/testdata/sf0.001").select("source", "page", "text")
    entries = queries.toy_sections(spark, "/root/testdata/sf0.001").select("source", F.col("seq").cast("int").alias("seq"), "marker_text", "id", "title")
    assert held_against_the_walk(entries, held, held.select("source", "page").limit(0)) > 5


def held_against_the_walk(entries, pages, located):
    """How many headings are found, after each has been compared."""
    found, report = sections.heading_pages(entries, pages, located)
    got = {(r.source, r.seq): r.pdf_page for r in found.collect()}
    told, cells = {}, {}
    target = t.heading_target(F.col("marker_text"), F.col("id"), F.col("title"))
    for r in entries.select("source", "seq", target.alias("o"), t.heading_variants(target).alias("v")).collect():
        told.setdefault(r.source, {})[r.seq] = (r.o, list(r.v))
    kept = pages.join(located, ["source", "page"], "left_anti")
    keyed = kept.select("source", "page", F.posexplode(F.filter(F.transform(t.lines_of(F.col("text")), t.strip), lambda x: x != "")).alias("k", "l"))
    pairs = keyed.alias("a").join(keyed.alias("b"), (F.col("a.source") == F.col("b.source")) & (F.col("a.page") == F.col("b.page")) & (F.col("b.k") == F.col("a.k") + 1), "left")
    for r in kept.select("source", "page").collect():
        cells[r.source, r.page] = []
    for r in pairs.select("a.source", "a.page", t.heading_key(F.col("a.l")).alias("x"), t.heading_key(F.concat("a.l", F.lit(" "), "b.l")).alias("y")).collect():
        cells[r.source, r.page].append((r.x, r.y))
    for d, own in told.items():
        queue = [(q, own[q]) for q in sorted(own) if own[q][0]]
        state = slow_walk(queue, sorted(p for k, p in cells if k == d), lambda page, x, d=d: slow_place(cells[d, page], x[1][1], x[1][0]))
        for q in own:
            assert got[d, q] == state.get(q, (None, None))[0], (d, q)
    assert len(got) == sum(map(len, told.values()))
    assert {r.source: r.headings_found for r in report.collect()} == {d: sum(v is not None for (k, _), v in got.items() if k == d) for d in told}
    return sum(v is not None for v in got.values())


def test_long_lines_are_cut_and_not_read_with_the_next_one(spark):
    """Keys hold no more than tells targets apart; a long line still counts as a heading's beginning."""
    long, prose = "Akutna astma dece " + "i mere " * 60, "red " * 200
    body = [("d", 1, "\n".join([prose, prose + "x", "kratak red", "drugi red", prose])), ("d", 2, f"{prose}\n{long}\n{prose}"), ("none", 1, prose)]
    entries = spark.createDataFrame([("d", 0, None, None, "Akutna astma dece"), ("d", 1, None, None, "Nema ga")], "source string, seq int, marker_text string, id string, title string")
    pages = spark.createDataFrame(body, "source string, page int, text string")
    assert held_against_the_walk(entries, pages, pages.select("source", "page").limit(0)) == 1
    targets = spark.createDataFrame([("d", 0, "akutna astma dece", 0.9)], "source string, seq int, target string, least double")
    got = [(r.page, r.line) for r in sections.page_lines(pages, targets).collect()]
    cut = ("red " * 200)[: S.overlap_line + 1]
    want = [(1, cut), (1, "kratak red"), (1, "drugi red"), (1, "kratak red drugi red"), (1, ("drugi red " + prose)[: S.overlap_line + 1]), (2, cut), (2, long.lower()[: S.overlap_line + 1])]
    assert sorted(got) == sorted(want)
