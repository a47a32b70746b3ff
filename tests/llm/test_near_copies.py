"""The pipeline's near copies: edited texts, repeats and rows without id."""

import random

import numpy as np

import corpus_pipeline
from leafmill.llm import near_copies

SCHEMA = "doc_id long, text string, lang string"


def jaccard(a, b):
    sets = []
    for text in (a, b):
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def brute(texts):
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = list(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if jaccard(texts[a], texts[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(k) for k in ids}


def test_edited_copies_go_and_others_stay(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(500)]
    texts = [None, "", "one", "One", "one two", "a b c d e", "a b c d f"]
    for _ in range(20):
        base = [rng.choice(words) for _ in range(rng.choice([60, 120, 300]))]
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 8):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(k, t, "aa") for k, t in rows], SCHEMA).repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute(dict(enumerate(texts))))


def test_copy_of_four_differing_bits(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    docs = spark.createDataFrame([(1, " ".join(base), "aa"), (2, " ".join(base[1:] + ["new"]), "aa")], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]


def test_one_row_of_repeats_and_rows_without_id(spark):
    base = " ".join(f"w{k}" for k in range(80))
    rows = [(5, base), (5, base), (5, base + " more"), (None, base), (None, "alone without id"), (None, "alone without id"), (7, "other text here"), (None, "Other text here")]
    docs = spark.createDataFrame([(k, t, "aa") for k, t in rows], SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "7", "None"]
    assert near_copies.one_of_each(docs.limit(0)).collect() == []


def test_cells_of_a_large_band(spark, monkeypatch):
    """Copies too different from the least one: bands are dealt out in cells, and no pair is lost."""
    monkeypatch.setattr(near_copies, "CELL", 2000)
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = []
    for k in range(160):
        own = list(base)
        for _ in range(rng.randrange(1, 7)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(40)}"
        texts.append(" ".join(own))
    rows = [(k, t, "a", "b", "c", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, kept string, root string, many int").repartition(3)
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute(dict(enumerate(texts))))


def test_forest_of_a_cell():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50)) for _ in range(40)]
    roots = [int(rng.integers(0, 8)) for _ in sets]
    edges = near_copies.forest(list(range(40)), roots, sets, 0.55)
    similar = lambda x, y: len(np.intersect1d(x, y)) >= 0.55 * len(np.union1d(x, y))
    assert all(similar(sets[a], sets[b]) and roots[a] != roots[b] for a, b in edges)

    def classes(pairs):
        up = list(range(8))
        for a, b in pairs:
            x, y = up[roots[a]], up[roots[b]]
            up = [y if k == x else k for k in up]
        return [up.index(k) for k in up]

    assert classes(edges) == classes([(a, b) for a in range(40) for b in range(a) if similar(sets[a], sets[b])])
    assert near_copies.forest([1], [5], [np.arange(3)], 0.8) == []
