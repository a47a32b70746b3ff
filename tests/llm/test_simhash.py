"""Near-duplicate fingerprints against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def slow_print(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    ids = list(prints)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def rows(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)] + ["ÉTÉ", "été", "Ab c"]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(12)]
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE\x0btwo", "a b c", "x" * 5000]
    for text in base:
        texts += [text, text.upper(), text.replace(" ", "\n", 3)]
        for _ in range(5):
            w = text.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts)], SCHEMA)


def test_against_brute_force(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {d: slow_print(t) for d, t in texts.items()}
    roots = slow_components(prints)
    assert rows(simhash.near_duplicates(docs)) == {d: (f"{prints[d]:016x}", roots[d]) for d in texts}


def test_empty_table_repeats_and_null_ids(spark, docs):
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.component_id) for r in simhash.near_duplicates(twice).collect()) == [(False, 3)] * 3 + [(True, 3)]


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_links_in_blocks(spark, block):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**63))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(20, int(rng.integers(0, 7)), replace=False)) for _ in range(60)}
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    found, _ = simhash.links(df, block=block)
    edges = [(r.a % 2**64, r.b % 2**64) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 21 for a, b in edges)
    want = slow_components({p: p for p in sorted(prints)})
    tied = {p: p for p in prints}

    def find(p):
        while tied[p] != p:
            p = tied[p]
        return p

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        tied[y] = x
    assert {p: find(p) for p in prints} == want
