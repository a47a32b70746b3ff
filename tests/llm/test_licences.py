"""The licence scan against plain comparison of words, and planted notices."""

import random
import re

import pytest

from leafmill.llm import licence_texts, licences

SCHEMA = "doc_id long, text string, labels string, n_words string"


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_base(text):
    words, found = slow_words(text), []
    for phrase, label in licence_texts.PHRASES.items():
        wanted = phrase.split()
        found += [(k, label) for k in range(len(words)) if words[k : k + len(wanted)] == wanted]
    return words, found


def slow_length(words, end, sequences):
    """The longest run of words before ``end`` that stands in a sequence."""
    for n in range(end, 0, -1):
        run = words[end - n : end]
        if any(own[k : k + n] == run for own in sequences for k in range(len(own) - n + 1)):
            return n
    return 0


def test_statistics_equal_the_longest_runs():
    rng = random.Random(1)
    for _ in range(40):
        named = [(str(k), " ".join(rng.choices("abc", k=rng.randint(1, 12)))) for k in range(4)]
        scanner = licences.Scanner({"a b": "x"}, named)
        sequences = [licences.words_of(text.encode()) for _, text in named] + [[b"a", b"b"]]
        words = [w.encode() for w in rng.choices("abcd", k=40)]
        for k, (state, length) in enumerate(scanner.statistics(iter(words)), 1):
            assert length == slow_length(words, k, sequences)
            run = words[k - length : k]
            held = sorted((t, e) for t, own in enumerate(sequences) for e in range(length, len(own) + 1) if own[e - length : e] == run)
            assert length == 0 or scanner.automaton.ends[state] == held


@pytest.mark.parametrize("chunk", [5, 64, 1 << 20])
def test_places_equal_plain_search_in_chunks(chunk):
    rng = random.Random(chunk)
    scanner = licences.Scanner(licence_texts.PHRASES, licence_texts.templates())
    bits = ["CC BY", "cc-by", "General Public", "License", "all rights", "reserved.", "ALL RIGHTS RESERVED", "x", "İ", "ß9", "\x00", "\n", "4.0", "Licensed under the"]
    for _ in range(60):
        text = " ".join(rng.choices(bits, k=rng.randint(0, 40)))
        told = scanner.told(text.encode(), chunk)
        words, found = slow_base(text)
        assert told.n_words == len(words)
        assert sorted(told.places) == sorted(found)
        whole = scanner.told(text.encode())
        assert (told.chains, told.best) == (whole.chains, whole.best)


def noise(rng, n):
    return " ".join("".join(rng.choices("bdfglmnprstvaeiou", k=rng.randint(2, 9))) for _ in range(n))


def test_every_template_alone_gets_its_label_alone():
    rng = random.Random(3)
    scanner = licences.Scanner(licence_texts.PHRASES, licence_texts.templates())
    for label, text in licence_texts.templates():
        spans = scanner.spans(scanner.told(f"{noise(rng, 30)} {text} {noise(rng, 30)}".encode()))
        assert [(x[0], x[1], x[4]) for x in spans] == [(label, 30, 1.0)], (label, spans)


def test_notices_with_lost_words_and_comment_signs_are_found():
    rng = random.Random(4)
    scanner = licences.Scanner(licence_texts.PHRASES, licence_texts.templates())
    for label, text in licence_texts.NOTICES.items():
        words = text.split()
        lines = [" * " + " ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
        at = len(lines) // 2
        lines.insert(at, " * Copyright 2020 Some Holder And Sons")
        spans = scanner.spans(scanner.told(("\n".join(lines) + " " + noise(rng, 20)).encode()))
        assert [x[0] for x in spans] == [label], (label, spans)
        holed = [w for k, w in enumerate(words) if k % 23 != 11]
        assert label in [x[0] for x in scanner.spans(scanner.told(" ".join(holed).encode()))]


def test_other_versions_and_parts_get_no_label():
    scanner = licences.Scanner(licence_texts.PHRASES, licence_texts.templates())
    for text in ("Licensed under the Apache License, Version 1.1", "Permission is hereby granted, free of charge, to any person", "licensed under the road of the MIT", "the rights to use, copy, modify, merge"):
        assert scanner.spans(scanner.told(text.encode())) == []
    notice = licence_texts.GNU_NOTICE.format(noun="program", name="General Public License", version="3")
    assert [x[0] for x in scanner.spans(scanner.told(notice.encode()))] == ["gpl-3.0-or-later"]


def test_defined_cases(spark):
    mit = licence_texts.NOTICES["mit"]
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (None, "Released under the MIT License.", None, None), (4, "CC BY and all rights reserved; CC BY", "x", "y"), (5, mit, "a", "b"), (5, mit, "a", "b"), (7, "word " * 300_000 + mit, "a", "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.n_words): r for r in licences.scanned(docs).collect()}
    assert licences.scanned(docs).count() == 7
    assert (got[1, 0].n_base, got[1, 0].first_word, got[1, 0].base_labels, got[1, 0].labels, got[1, 0].score) == (0, None, "", "", 0.0)
    assert (got[2, 0].last_word, got[2, 0].labels) == (None, "")
    assert (got[None, 5].labels, got[None, 5].base_labels, got[None, 5].score) == ("mit", "", 1.0)
    four = got[4, 8]
    assert (four.n_base, four.first_word, four.last_word, four.base_labels, four.labels, four.score) == (3, 0, 6, "cc-by,reserved", "cc-by,reserved", 1.0)
    long = next(r for k, r in got.items() if k[0] == 7)
    assert long.labels == "mit" and long.spans[0].first_word == 300_000
    assert licences.scanned(docs.limit(0)).count() == 0
    assert licences.labelled(docs).where("doc_id = 5").count() == 2


def test_the_tables_places(spark):
    from leafmill.llm import queries

    found = {r.doc_id: r for r in queries.op12_licence_scan(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        words, places = slow_base(d.text)
        starts = [k for k, _ in places]
        r = found[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        said = {"Apache License, Version 2.0": "apache-2.0", "under the MIT License": "mit", "GNU General Public License, version 3": "gpl-3.0", "under CC BY-NC 4.0": "cc-by-nc-4.0"}
        own = {label for text, label in said.items() if text in (d.text or "")} | {x for _, x in places}
        assert r.labels == ",".join(sorted(own))
