"""Substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np

from leafmill.llm import substrings as sub


def brute(docs):
    """doc_id -> (n_words, n_removed, sha256), windows judged on the input."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs.items()}
    first = {}
    for d in sorted(words):
        for k in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][k : k + 50]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < d:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def planted(seed=2):
    rng = random.Random(seed)
    fresh = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 60, 80, 200, 700)]
    docs = {0: None, 1: "", 2: " \n", 3: "few words here", 4: " ".join(["same"] * 300), 5: " ".join(["same"] * 120)}
    for d in range(6, 70):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edit"
            if rng.random() < 0.3:
                p = p[rng.randrange(20) :]
            parts += fresh(rng.randrange(0, 40)) + p
        docs[d] = rng.choice([" ", "\n", "\x0b \t"]).join(parts)
    docs[70], docs[71] = docs[20], docs[20]
    docs[72] = docs[20] + " é ü" + " x" * 3
    return docs


def test_against_brute_force(spark):
    docs = planted()
    order = list(docs)
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(d, docs[d], "n", 0) for d in order], "doc_id long, text string, anchor string, first int").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sub.deduplicated(df).collect()}
    assert got == brute(docs)
    assert sum(r[1] for r in got.values()) > 1000


def test_segments_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sub, "SEGMENT", 64)
    rng = np.random.default_rng(0)
    words = rng.integers(0, 2**63, 1000).astype(np.uint64)
    anchor, first, n, at = sub.anchored(words)
    assert ((first <= at) & (at + sub.ANCHOR <= first + sub.WINDOW)).all()
    assert n.sum() == 951 and first[0] == 0 and (np.diff(first) == n[:-1]).all()
    moved, *_ = sub.anchored(words[100:])
    assert len(set(moved.tolist()) - set(anchor.tolist())) <= 1


def test_run_hashes_agree_wherever_the_run_is():
    words = np.arange(200, dtype=np.uint64) % np.uint64(70) * np.uint64(0x9E3779B97F4A7C15)
    for length in (1, 2, 19, 50):
        runs = sub.run_hashes(words, length)
        assert (runs[:60] == runs[70:130]).all() and len(set(runs[:60].tolist())) == 60
    starts, ends = np.array([0, 70, 1]), np.array([55, 125, 56])
    a, b, c = sub.stretch_hashes(words, starts, ends)
    assert a == b != c


def test_null_ids_repeats_and_empty(spark):
    text = " ".join(f"a{k}" for k in range(60))
    df = spark.createDataFrame([(7, text), (7, text), (None, text), (9, text)], "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in sub.deduplicated(df).collect())
    assert got == [(-1, 0), (7, 0), (7, 0), (9, 60)]
    assert sub.deduplicated(df.limit(0)).collect() == []


def brute_rows(rows):
    """The same for rows (doc_id, text) that may share a doc_id."""
    words = [(d, (t or "").split()) for d, t in rows]
    first = {}
    for d, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), d)
    out = []
    for d, w in words:
        gone = {p for k in range(len(w) - 49) if d is not None and first[tuple(w[k : k + 50])] < d for p in range(k, k + 50)}
        out.append((-1 if d is None else d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_one_id_with_different_texts(spark):
    long, other = " ".join(f"v{k}" for k in range(700)), " ".join(f"w{k}" for k in range(60))
    edited = long.replace("v300 ", "edit ")
    rows = [(1, long), (7, long), (7, other), (7, other + " " + long[:900]), (8, other + " tail"), (1, edited), (9, edited + " " + other), (9, "short"), (None, long), (7, long)]
    got = sub.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), whole=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got) == brute_rows(rows)
    for r in got:
        assert sum(s.n for s in r.spans) == r.n_removed


def test_many_variants_of_one_passage(spark):
    """Near copies: factors end at edits, and windows across them stand in several documents."""
    rng = random.Random(4)
    base = [f"p{k}" for k in range(260)]
    rows = []
    for d in range(120):
        own = list(base)
        for k in rng.sample(range(0, 260, 20), rng.randrange(4)):
            own[k] = f"edit{rng.randrange(3)}"
        rows.append((rng.randrange(60), " ".join(own[rng.randrange(80) :])))
    got = sub.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), whole=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got) == brute_rows(rows)


def test_factors_are_the_longest_through_a_place():
    a, b = list("xxabcdefyy"), list("qabcdefz")
    assert sub.agreement(a, 4, b, 3) == (2, 8)
    assert sub.agreement(a, 0, b, 0) == (0, 0)
    assert sub.agreement(a, 2, b, 1) == (2, 8)
