"""Language ID: gradients, pooling, held-out accuracy and edge rows."""

import random
import zlib

import numpy as np

from leafmill.llm import language

PARTS = {"aa": "the and ing tion er re on", "bb": "été eau que oi ment les ch", "cc": "ungs sch ein ver ß ä ich"}


def sentence(rng, lang, n):
    parts = PARTS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_gradients_through_time():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"], 3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    codes = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    mask, labels = (rng.random((7, 5)) < 0.8).astype(float), rng.integers(0, 3, 5)
    _, grads = net.gradients(codes, mask, labels)
    for name, w in net.weights.items():
        used = [(int(codes[0, 0]), k) for k in range(0, 24, 5)] if name.startswith("in") else [tuple(int(rng.integers(s)) for s in w.shape) for _ in range(4)]
        for at in used:
            old, d = w[at], 1e-3
            w[at] = old + d
            up, _ = net.gradients(codes, mask, labels)
            w[at] = old - d
            down, _ = net.gradients(codes, mask, labels)
            w[at] = old
            assert abs((up - down) / (2 * d) - grads[name][at]) < 2e-3, (name, at)


def test_pooling_is_the_mean_over_whole_texts():
    net = language.Network(["a", "b"], 1)
    texts = [b"x" * 5, b"abc " * 100, b"q" * 64, bytes(range(256)) * 20]
    together = language.document_probabilities(net, texts)
    for text, p in zip(texts, together):
        assert np.allclose(language.document_probabilities(net, [text])[0], p, atol=1e-5)
        total = np.zeros(2)
        for k in range(0, len(text), 64):
            own = np.zeros((64, 1), np.uint8)
            own[: len(text[k : k + 64]), 0] = np.frombuffer(text[k : k + 64], np.uint8)
            total += net.probabilities(own)[: len(text[k : k + 64]), 0].sum(axis=0)
        assert np.allclose(total / len(text), p, atol=1e-5)


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(4)
    rows = []
    for k in range(600):
        lang = rng.choice(list(PARTS))
        rows.append((k, sentence(rng, lang, rng.randrange(8, 60)), lang, "s", 1.0))
    rows += [(600, None, "aa", "s", 0.0), (601, "", "aa", "s", 0.0), (602, "12 34 !!", "bb", "s", 0.0), (603, rows[0][1], None, "s", 0.0), (None, rows[0][1], None, "s", 0.0), (604, sentence(rng, "bb", 40_000), "bb", "s", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(3)
    bounds = language.Bounds(epochs=12, rate=0.02, lanes=64)
    got = {r.doc_id: r for r in language.identified(docs, bounds).collect()}
    out = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k in range(600) if got[k].held_out} == set(out)
    assert np.mean([got[k].lang_pred == rows[k][2] for k in out]) > 0.95
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (600, 601, 602))
    assert got[603].lang_pred == got[None].lang_pred == got[0].lang_pred and not got[None].held_out
    assert got[604].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())
    kept = language.recognised(docs, bounds=bounds)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {600, 601, 602} and len(ids) > 590
    assert language.identified(docs.limit(0), bounds).collect() == []
    blank = language.identified(docs.selectExpr("doc_id", "text", "cast(null as string) lang"), bounds)
    assert {r.lang_pred for r in blank.collect()} == {"und"}


def test_unlearned_languages_and_lettered_junk_go(spark):
    rng = random.Random(8)
    rows = [(k, sentence(rng, lang := list(PARTS)[k % 3], rng.randrange(8, 60)), lang) for k in range(600)]
    latin, cyrillic = "kwa zumo ryk wozy xip vaq".split(), "при вет до сло ка мир".split()
    other = [" ".join("".join(rng.choice(p) for _ in range(rng.randrange(1, 4))) for _ in range(40)) for p in [latin, cyrillic] * 10]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ") for _ in range(300)) for _ in range(10)]
    junk += ["x" * 300, "qz" * 150, "漢字" * 100, "\u03b1\u03b2\u03b3 " * 60]
    planted = [(1000 + k, t, None) for k, t in enumerate(other + junk)]
    for labels in (3, 1):
        clean = [r for r in rows if labels == 3 or r[2] == "bb"]
        docs = spark.createDataFrame(clean + planted, "doc_id long, text string, lang string")
        ids = {r.doc_id for r in language.recognised(docs, bounds=language.Bounds(epochs=12, rate=0.02, lanes=64)).collect()}
        assert not ids & {k for k, *_ in planted}
        assert len(ids) >= 0.99 * len(clean)


def test_evidence_comes_from_all_texts(spark):
    """Pairs of every learned text, whole, and prefixes of every held-out text count, however many there are."""
    rng = random.Random(6)
    rows = [(k, sentence(rng, lang := list(PARTS)[k % 2], rng.randrange(1, 8)), lang) for k in range(6000)]
    rows += [(6001, sentence(rng, "aa", 3000), "aa"), (None, "null id", "aa"), (6002, None, "aa"), (6003, "12 34", "bb"), (6004, "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    want = np.zeros((2, 256, 256))
    for k, text, lang in rows:
        own = (text or "").encode()
        if k is not None and lang and not held(k):
            for pair in zip(own, own[1:]):
                want[["aa", "bb"].index(lang)][pair] += 1
    counts = language.pair_counts(docs, ["aa", "bb"])
    assert (counts == want).all()
    net, known = language.Network(["aa", "bb"], 1), language.Evidence(counts)
    seen = language.held_out_steps(docs, net, known)
    out = [(text.encode(), lang) for k, text, lang in rows if k is not None and held(k) and lang and any(c.isalpha() for c in text or "")]
    assert len(out) > 1400
    for k, size in enumerate(language.PREFIXES):
        own = [(x[:size], lang) for x, lang in out if len(x) >= size]
        right = 0 if not own else sum(net.labels[i] == lang for i, (_, lang) in zip(language.document_probabilities(net, [x for x, _ in own]).argmax(axis=1), own))
        assert sum(seen.get((k, 0), {}).values()) == sum(seen.get((k, 1), {}).values()) == right
    texts = [x for x, _ in out[:50]] + [b"abc " * 700, b"x" * 64, b"y" * 129]
    for k, own, p in language.prefix_probabilities(net, texts):
        assert np.allclose(p, language.document_probabilities(net, [texts[i][: language.PREFIXES[k]] for i in own]), atol=1e-5)


def test_held_out_texts_are_looked_at_whole(spark):
    """Every byte counts: prefixes go on to the text's end, and the text itself is one more witness of its length."""
    rng = random.Random(9)
    rows = [(k, sentence(rng, lang := list(PARTS)[k % 2], [3, 40, 900, 4000][k % 4]) + " x" * (k % 7), lang) for k in range(200)]
    rows += [(200 + k, "ab" * 4096, "aa") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    net, known = language.Network(["aa", "bb"], 1), language.Evidence(language.pair_counts(docs, ["aa", "bb"]))
    seen = language.held_out_steps(docs, net, known)
    want = {}
    for k, text, lang in rows:
        own = text.encode()
        if zlib.crc32(str(k).encode()) % 4 != 2:
            continue
        sizes = [size for size in language.PREFIXES if size <= len(own)]
        assert len(own) < 2 * sizes[-1]
        for place, size in [*enumerate(sizes), *([(len(sizes) - 1, len(own))] if len(own) > sizes[-1] else [])]:
            p = language.document_probabilities(net, [own[:size]])[0]
            if net.labels[p.argmax()] == lang:
                whole = 2 * (size not in sizes)
                want.setdefault((place, whole), []).append(p.max())
                want.setdefault((place, whole + 1), []).append(known.pairs(own[:size]))
    assert max(k for k, _ in want) > 10 and {side for _, side in want} == {0, 1, 2, 3}
    assert set(seen) == set(want)
    for key, values in want.items():
        steps = np.repeat(sorted(seen[key]), [seen[key][x] for x in sorted(seen[key])])
        # float sums in another order may fall into the step beside
        assert len(steps) == len(values) and np.abs(np.sort(np.floor(np.array(values) * language.FINE[key[1] % 2])) - steps).max() <= 1


def test_whole_texts_bound_their_length():
    known = language.Evidence(np.ones((1, 256, 256)))
    seen = {(10, side): {[9000, -3000][side % 2]: 20} for side in range(2)} | {(10, side): {[8000, -4000][side % 2]: 20} for side in (2, 3)}
    assert known.bounded(seen).bounds[10].tolist() == [0.5, -4.0]
