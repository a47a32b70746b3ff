"""The source audit against all terms one by one."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, item string, value string"


def slow(docs, least=10, top=10):
    counts, holders, groups = {}, {}, set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        counts.setdefault((lang, source), Counter()).update(words)
        holders.setdefault(lang, Counter()).update(set(words))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in holders[lang].items() if n >= least]
        own = sorted(s for x, s in groups if x == lang)
        every = Counter()
        for s in own:
            every += counts[lang, s]

        def shares(count):
            whole = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // whole for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in own}, shares(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def audit(spark, docs, **more):
    rows = [(k, *d, "a", "b", "c") for k, d in enumerate(docs)]
    found = divergence.audited(spark.createDataFrame(rows, SCHEMA), **more)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(found.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    return sorted(map(tuple, found.collect()))


def made(rng, n, sources, words):
    out = []
    for _ in range(n):
        source = rng.choice(sources)
        own = [w for k, w in enumerate(words) if (k + len(source or "")) % 3]
        out.append((" ".join(rng.choices(own, k=rng.randint(0, 25))), rng.choice(["en", "fr", None, ""]), source))
    return out


def test_equals_terms_one_by_one(spark):
    rng = random.Random(1)
    words = ["The", "the", "of", "ÉTÉ", "été", "x1y", "Straße", "😀", "İ", "dog's", "ǅ"] + [f"w{chr(97 + k)}" for k in range(26)]
    docs = made(rng, 300, ["a", "b", "c", "d", None, "ł", "only"], words) + [(None, "en", "quiet"), ("", "de", "alone"), (None, None, None), ("rare words here", "xx", "p"), ("rare words", "xx", "q")]
    assert audit(spark, docs) == slow(docs)
    assert audit(spark, docs, least_docs=3, top=4) == slow(docs, 3, 4)


def test_blocks_of_sources_and_slices_of_vectors(spark, monkeypatch):
    rng = random.Random(2)
    docs = made(rng, 400, [f"s{k}" for k in range(23)], [f"t{chr(97 + k)}" for k in range(20)])
    monkeypatch.setattr(divergence, "BLOCK", 4)
    monkeypatch.setattr(divergence, "CELLS", 50)
    assert audit(spark, docs, least_docs=2) == slow(docs, 2)


def test_many_terms_of_one_vector_and_ties(spark):
    docs = [(" ".join(f"same{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)), "en", s) for s in ("a", "b") for _ in range(10)] + [("other", "en", "c")] * 10
    got = audit(spark, docs)
    assert got == slow(docs)
    assert len([r for r in got if r[2] == "term" and r[1] == "a"]) == 10


def test_empty_table(spark):
    assert audit(spark, [], least_docs=1) == []


@pytest.mark.parametrize("whole", [2, 1000, 8_999_999_999_999_999])
def test_shares_are_exact(whole):
    rng = random.Random(whole)
    n = np.array([0, whole - 2, *[rng.randrange(whole - 1) for _ in range(500)]], np.int64)
    assert divergence.shares_of(n, np.full(len(n), whole)).tolist() == [1 + 1_000_000_000 * (int(x) + 2) // whole for x in n]
