"""Benchmark decontamination against brute force and planted passages."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import decontaminate as d

RNG = random.Random(8)
COMMON = ["the", "of", "and", "to", "in", "is"]
RARE = [f"{RNG.choice('bcdfgl')}{RNG.choice('aeiou')}{k:x}" for k in range(3000)]


def prose(n):
    words = [RNG.choice(COMMON) if RNG.random() < 0.4 else RNG.choice(RARE) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))


ITEMS = [prose(n) for n in (15, 20, 26, 33, 41, 48, 52, 59)] + ["", None, "the of", "Zanzibar quark"]


def docs_and_plants():
    rows, planted = [], set()
    for k in range(160):
        text = prose(RNG.randrange(1, 300))
        if k % 4 == 0:
            item = RNG.randrange(8)
            words = ITEMS[item].split()
            if k % 8 == 0:  # a paraphrase: every twelfth word differs
                words = [w if j % 12 != 5 else "other" for j, w in enumerate(words)]
            at = RNG.randrange(0, 50)
            text = " ".join(text.split()[:at] + words + text.split()[at:]).upper()
            planted.add((k, item))
        rows.append((k, text))
    rows += [(200, None), (201, ""), (202, "A Zanzibar, quark!"), (203, ITEMS[3]), (204, ITEMS[3]), (204, ITEMS[3]), (205, prose(20_000) + " " + ITEMS[5])]
    planted |= {(203, 3), (204, 3), (205, 5)}
    return rows, planted


def brute(rows):
    """All pairs by the same check at every place, no retrieval."""
    table = np.zeros((d.FEATURES + 1, d.RANK), np.float32)
    held = [(k, (t or "").encode()) for k, t in enumerate(ITEMS) if len(d.words_of((t or "").encode())) >= 5]
    items = d.Items([k for k, _ in held], [d.words_of(t) for _, t in held], [d.answer_of(t) for _, t in held], table)
    out = set()
    for doc, text in rows:
        words = d.words_of((text or "").encode())
        for k, own in enumerate(items.words):
            size = d.size_class(len(own))
            places = [(at, size, 1.0) for at in range(0, max(1, len(words)), d.STEP)]
            if words and items.checked(k, words, places):
                out.add((doc, items.ids[k]))
        for k, text in enumerate(ITEMS):
            own = d.words_of((text or "").encode())
            if 0 < len(own) < 5 and any(words[i : i + len(own)] == own for i in range(len(words))):
                out.add((doc, k))
    return out


@pytest.fixture(scope="module")
def made(spark):
    rows, planted = docs_and_plants()
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, item_id int, cosine string").repartition(3)
    return rows, planted, docs, spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")


def test_recall_against_brute_force(made):
    rows, planted, docs, benchmark = made
    found = [(r.doc_id, r.item_id) for r in d.matches(docs, benchmark).collect()]
    want = brute(rows)
    assert planted <= want
    assert set(found) <= want
    assert len(set(found) & want) >= 0.95 * len(want)
    assert found.count((204, 3)) == 2


def test_blocks_of_items_and_filter(made, monkeypatch):
    rows, planted, docs, benchmark = made
    whole = {(r.doc_id, r.item_id) for r in d.matches(docs, benchmark).collect()}
    monkeypatch.setattr(d.blocks, "__defaults__", (3,))
    assert {(r.doc_id, r.item_id) for r in d.matches(docs, benchmark).collect()} == whole
    kept = d.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in rows} - {k for k, _ in whole}


def test_band_with_the_answer_and_brief_items(spark):
    """Items of which 0.62 to 0.8 stays, the answer whole, and brief items as they are: all are found."""
    rng = random.Random(21)
    items, rows, want = [], [], set()
    for k in range(120):
        n = 5 + k % 10 if k < 60 else rng.randrange(16, 60)
        words = [rng.choice(RARE) for _ in range(n)]
        items.append(" ".join(words) if k < 60 else " ".join(words[: n * 2 // 3]) + ". " + " ".join(words[n * 2 // 3 :]))
        own = list(words)
        if k >= 60:
            asked = range(n * 2 // 3)
            for j in rng.sample(asked, int((1 - (0.62, 0.7, 0.78)[k % 3]) * n)):
                own[j] = rng.choice(RARE)
        text = prose(rng.randrange(20, 200)).split()
        at = rng.randrange(len(text))
        rows.append((k, " ".join(text[:at] + own + text[at:])))
        want.add((k, k))
    rows += [(1000 + k, prose(200)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = d.matches(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(found & want) >= 0.98 * len(want) and found <= want
    assert all(0 <= r.cosine <= 1 for r in got)


def test_empty_tables(made):
    _, _, docs, benchmark = made
    assert d.matches(docs.limit(0), benchmark).collect() == []
    assert d.matches(docs, benchmark.limit(0)).collect() == []


def test_common_length():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(300):
        a, b = ([RNG.choice([b"a", b"b", b"c", b"d"]) for _ in range(RNG.randrange(0, 20))] for _ in range(2))
        assert d.common_length(len(a), d.places_of(a), b) == slow(a, b)


def test_svd_finds_the_leading_directions(spark):
    texts = [prose(200) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    n = d.frequencies(docs)
    idf = d.weights(n)
    row, column, value = d._passages([t.encode() for t in texts], idf)
    dense = np.zeros((row.max() + 1, d.FEATURES))
    dense[row, column] = value
    basis = np.random.default_rng(0).normal(size=(d.FEATURES, 3))
    sample = docs.select(d.text_bytes())
    assert np.allclose(d._inner(sample, idf, basis), (dense @ basis).T @ (dense @ basis))
    draws = np.random.default_rng(d.DRAW).normal(size=(d.FEATURES, d.RANK + d.EXTRA))
    found, wanted = d._basis(sample, idf), dense.T @ (dense @ draws)
    assert np.allclose(found @ (found.T @ wanted), wanted)


def test_directions_come_from_every_distinct_text(spark):
    """Far more passages than were once drawn: the directions are those of all of them, copies once."""
    rng = random.Random(34)
    texts = [" ".join(rng.choice(RARE if rng.random() < 0.5 else COMMON) for _ in range(6)) for _ in range(40_000)]
    texts += [prose(130), prose(500)]
    docs = spark.createDataFrame([(t,) for t in texts + texts[:2000] + [None, ""]], "text string").repartition(5)
    n = d.frequencies(docs)
    assert n[d.FEATURES] == sum(-(-len(d.words_of(t.encode())) // d.PASSAGE) for t in texts + texts[:2000])
    idf = d.weights(n)
    row, column, value = d._passages(sorted({t.encode() for t in texts}), idf)

    def times(basis):
        return np.stack([np.bincount(row, value * x[column]) for x in basis.T], axis=1)

    draws = np.random.default_rng(d.DRAW).normal(size=(d.FEATURES, d.RANK + d.EXTRA))
    basis = np.linalg.qr(np.stack([np.bincount(column, value * x[row], d.FEATURES) for x in times(draws).T], axis=1))[0]
    inner = times(basis).T @ times(basis)
    values, vectors = np.linalg.eigh(inner)
    best = np.argsort(-values)[: d.RANK]
    wanted = idf[:, None] * (basis @ vectors[:, best]) / np.sqrt(values[best])
    found = d.projection(docs)
    some = d.features_of(d.clean(" ".join(RARE[:300]).encode()))
    # signs and order of equal directions are open, products of words are not
    one, two = wanted[some] @ wanted[some].T, found[some].astype(float) @ found[some].T.astype(float)
    assert np.abs(one - two).max() < 1e-3 * np.abs(one).max()


def test_size_classes():
    assert [d.size_class(n) for n in (1, 16, 17, 24, 25, 33, 48, 49, 65, 97, 129)] == [16, 16, 24, 24, 32, 40, 48, 56, 80, 112, 160]


def test_items_and_documents_without_id(made):
    """Items without id are searched like all others, and documents without id are reported as such."""
    rows, planted, docs, benchmark = made
    spark = docs.sparkSession
    whole = {(r.doc_id, r.item_id) for r in d.matches(docs, benchmark).collect()}
    nameless = benchmark.withColumn("item_id", F.when(F.col("item_id") % 2 == 0, F.col("item_id")))
    got = Counter((r.doc_id, r.item_id) for r in d.matches(docs, nameless).collect())
    want = Counter()
    for r in d.matches(docs, benchmark).collect():
        want[r.doc_id, r.item_id if r.item_id % 2 == 0 else None] += 1
    assert got == want and any(item is None for _, item in got)
    left = {r.doc_id for r in d.decontaminated(docs, nameless.withColumn("item_id", F.lit(None).cast("long"))).collect()}
    assert left == {k for k, _ in rows} - {k for k, _ in whole}
    texts = dict(rows)
    one = next(iter(planted))
    lost = spark.createDataFrame([(None, texts[one[0]], 1, "x"), (1, None, 1, "x")], docs.schema).unionByName(docs)
    assert any(r.doc_id is None and r.item_id == one[1] for r in d.matches(lost, benchmark).collect())
