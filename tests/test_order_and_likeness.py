"""Ancestors, merged lines, like terms and met templates against plain loops."""

import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as t
from leafmill.operators import entities, questions, sections, toc
from leafmill.packs import LanguagePack, Settings


def test_ancestors_of_many_rows_in_one_group(spark):
    rng = random.Random(1)
    levels = [rng.choice([None, *range(1, 40)]) if k % 1000 == 0 else rng.randint(1, 40) for k in range(100_000)]
    rows = spark.createDataFrame([("d", k, x) for k, x in enumerate(levels)], "source string, seq int, level int")
    began = time.time()
    got = {r.seq: r.parent_seq for r in sections.ancestors(rows, ["source"]).collect()}
    assert time.time() - began < 30
    stack = []
    for k, x in enumerate(levels):
        while stack and (x is None or stack[-1][1] >= x):
            stack.pop()
        assert got[k] == (stack[-1][0] if stack else None)
        if x is not None:
            stack.append((k, x))


def test_groups_of_one_partition_do_not_mix(spark):
    rows = [(d, k, 1 + (k + d) % 3) for d in range(30) for k in range(10)]
    df = spark.createDataFrame(rows, "d long, seq int, level int").coalesce(1)
    got = {(r.d, r.seq): r.parent_seq for r in sections.ancestors(df, ["d"]).collect()}
    for d, k, x in rows:
        assert got[d, k] == max((j for e, j, y in rows if e == d and j < k and y < x), default=None)


def slow_merge(rows):
    out = []
    for r in rows:
        head = out[-1] if out else None
        if head and r["_family"] is None and not head["closed"]:
            chapter = head["family"] == "rimski" and r["_next"] == "rimski" and r["_style"] == "upper" and len(r["text"]) < 60
            if r["_lower"] or head["open"] or chapter:
                head["text"] += " " + r["text"]
                head["page"] = head["page"] if r["page"] is None else r["page"]
                head["closed"], head["open"] = r["_closed"], r["_open"]
                continue
        out.append({"text": r["text"], "page": r["page"], "pdf": r["pdf"], "family": r["_family"], "closed": r["_closed"], "open": r["_open"]})
    return [(x["text"], x["page"], x["pdf"]) for x in out]


def test_merged_lines_equal_the_fold(spark):
    rng = random.Random(2)
    bits = ["I. Uvod", "II. Mere,", "IV Kraj", "VELIKI NASLOV", "DRUGI DEO.", "nastavak reda", "nastavak,", "Običan red", "1.2 Odeljak", "1.2 Odeljak;", "A. Slovo", "kraj.", "POGLAVLJE 3. Naslov", "– stavka", "DUG " * 16]
    rows = [(f"d{d}", k, rng.choice(bits), rng.choice([None, 3, 7]), 1 + k // 9) for d in range(60) for k in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "source string, seq int, text string, printed_page int, pdf_page int")
    x = F.col("text")
    told = df.select("*", t.marker_family(x).alias("f"), t.style(x).alias("s"), x.rlike(r"\A\p{Ll}").alias("l"), t.ends_sentence(t.rstrip(x)).alias("c"), t.rstrip(x).rlike(r"[,;:]\z").alias("o"))
    held = {}
    for r in told.orderBy("source", "seq").collect():
        held.setdefault(r.source, []).append({"text": r.text, "page": r.printed_page, "pdf": r.pdf_page, "_family": r.f, "_style": r.s, "_lower": r.l, "_closed": r.c, "_open": r.o})
    got = {}
    for r in toc.merged_lines(df).orderBy("source", "seq").collect():
        got.setdefault(r.source, []).append((r.text, r.printed_page, r.pdf_page))
        assert r.seq == len(got[r.source])
    for d, own in held.items():
        for a, b in zip(own, own[1:] + [None]):
            a["_next"] = b["_family"] if b else None
        assert got[d] == slow_merge(own), d
    assert "applyInPandas" not in open(toc.__file__).read()


def slow_best(term, known, s):
    best = (s.term_fuzzy, None)
    for k in sorted(known):
        if abs(len(k) - len(term)) <= s.term_gap and (ratio := SequenceMatcher(None, term, k).ratio()) > best[0]:
            best = (ratio, k)
    return best[1]


@pytest.mark.parametrize("threshold,gap", [(0.82, 3), (0.6, 2), (0.35, 3)])
def test_like_terms_equal_all_pairs(spark, threshold, gap):
    rng = random.Random(int(100 * threshold))
    s = Settings(term_fuzzy=threshold, term_gap=gap, term_fuzzy_min=3)
    word = lambda: "".join(rng.choices("aabcdeš ", k=rng.randint(1, 14))).strip() or "x"
    known = {word() for _ in range(120)}

    def edited(x):
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(x) + 1)
            x = rng.choice([x[:at] + rng.choice("abq") + x[at:], x[:at] + x[at + 1 :], x[:at] + "z" + x[at + 1 :]]) or "x"
        return x

    terms = {edited(rng.choice(sorted(known))) for _ in range(250)} | {word() for _ in range(100)} | {"", "ab"}
    df = spark.createDataFrame([(x,) for x in terms] * 2, "term string")
    got = {r.term: r.corrected for r in entities.fuzzy_terms(df, LanguagePack(known_terms=sorted(known)), s).collect()}
    assert got == {x: x if len(x) < 3 or x in known else slow_best(x, known, s) or x for x in terms}


def test_a_hundred_thousand_known_terms(spark):
    rng = random.Random(9)
    syllables = ["ka", "pro", "ti", "men", "lo", "ra", "sti", "ver", "no", "di", "pul", "mo", "ge", "hi", "bron"]
    known = sorted({"".join(rng.choices(syllables, k=rng.randint(3, 7))) for _ in range(130_000)})[:100_000]
    asked = [x[:3] + "q" + x[4:] for x in rng.sample(known, 40)] + ["zzzzzzzz", *rng.sample(known, 5)]
    began = time.time()
    df = spark.createDataFrame([(x,) for x in asked], "term string")
    got = {r.term: r.corrected for r in entities.fuzzy_terms(df, LanguagePack(known_terms=known)).collect()}
    assert time.time() - began < 120
    held, s = set(known), Settings()
    for x in asked[:6] + asked[40:]:
        assert got[x] == (x if x in held else slow_best(x, known, s) or x)


def test_a_hot_type_brings_no_rows_to_templates_that_ask_for_more(spark):
    rows = [(f"c{k}", "s", {"drug": [f"drug {k}"], "dose": ["10 mg"], **({"rare": ["one"]} if k % 100 == 0 else {}), **({"empty": ["x"]} if k % 2 else {})}) for k in range(400)]
    held = spark.createDataFrame(rows, "chunk_id string, source string, entities map<string,array<string>>").withColumns({"pdf_page": F.lit(1), "section_path": F.array().cast("array<string>"), "section_ids": F.array().cast("array<string>")})
    forms = [(1, "hot", "What is {drug}?", "i", ["drug"]), (2, "both", "{drug} with {rare} here?", "i", ["drug", "rare"]), (3, "none", "{drug} with {nothing}?", "i", ["drug", "nothing"]), (4, "short", "{drug} is {empty}?", "i", ["drug", "empty"])]
    templates = spark.createDataFrame(forms, "seq int, id string, template string, intent string, requires array<string>")
    told = templates.select(F.col("seq").alias("_seq"), F.col("id").alias("template_id"), "requires")
    met = {r.template_id: r["count"] for r in questions.met_templates(held, told, 2).groupBy("template_id").count().collect()}
    assert met == {"hot": 400, "both": 4}
    made = {r.template_id: r["count"] for r in questions.generated(held, templates).groupBy("template_id").count().collect()}
    assert made == {"hot": 400, "both": 4}
