"""Token counts, token files and pieces against plain statements and the libraries."""

import random
import zlib

import numpy as np
import pytest

from leafmill.llm import pieces, token_files, wordpieces
from leafmill.llm.queries import vocabulary_file

RNG = random.Random(9)
LETTERS = "abcdefghijklmnoprstuvwéèñßäöü"
WORDS = ["".join(RNG.choice(LETTERS) for _ in range(RNG.randrange(1, 12))) for _ in range(300)]
TEXTS = [
    None,
    "",
    " ",
    "\n\t \x0b\x1c\x85 a",
    "hello world, it's John's 1234 tests!!  x  y\n\n z ''s 's 'll b",
    "日本語のテキスト 和 русский язык ελληνικά 😀🤖 ½²x ١٢٣",
    "▁literal ▁▁ marks \x00 zero <|endoftext|> <s> <0x0A>",
    "x" * 3000 + " " * 50 + "e" * 70,
    *(" ".join(RNG.choice(WORDS) + RNG.choice(["", ",", ".\n", "  "]) for _ in range(200)) for _ in range(20)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", 7) for k, t in enumerate(TEXTS)] + [(None, "no id", "", 0), (4, TEXTS[4], "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)


def greedy(word, vocabulary, longest):
    n = at = 0
    while at < len(word):
        size = next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
        at, n = at + size, n + 1
    return n


def test_word_pieces(docs):
    path = vocabulary_file("byte_bpe_50k.json")
    vocabulary = set(wordpieces.vocabulary(path))
    assert len(vocabulary) == 50_256
    longest = max(map(len, vocabulary))
    got = {r.doc_id: r for r in wordpieces.counted(docs, path).collect()}
    for k, text in enumerate(TEXTS):
        words = (text or "").encode().split()
        want = sum(greedy(b" " + w, vocabulary, longest) for w in words)
        assert (got[k].n_bytes, got[k].n_words, got[k].n_tokens) == (len((text or "").encode()), len(words), want)
    assert wordpieces.counted(docs.limit(0), path).collect() == []


def test_automaton_on_a_small_vocabulary():
    vocabulary = [bytes([b]) for b in range(256)] + [b"ab", b"abcd", b"bcde", b"cdx", b"aab"]
    automaton = wordpieces.Automaton(vocabulary)
    for _ in range(500):
        word = bytes(RNG.choice(b"abcdex") for _ in range(RNG.randrange(0, 14)))
        assert automaton.count(word) == greedy(word, set(vocabulary), 4)
    with pytest.raises(ValueError):
        wordpieces.Automaton([b"a"])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_coding_round_trip(n):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
    control, data = token_files.coded(values)
    assert len(control) == -(-n // 4)
    assert (token_files.decoded(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == values).all()


def test_file_round_trip_and_damage(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 64)
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 1000), 60_000).astype(np.uint32)
    docs, counts = np.arange(5) * 3, np.array([1, 499, 0, 400, 100])
    content = b"".join(token_files.file_parts(docs, counts, ids))
    a, b, c = token_files.read_file(content)
    assert (a == docs).all() and (b == counts).all() and (c == ids).all()
    with pytest.raises(ValueError):
        token_files.read_file(content[:200] + b"?" + content[201:])


def test_token_table(spark, docs, monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    start, want = 0, []
    for known, doc, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_files.token_table(docs, path).collect()), key=lambda r: r[1])
    assert got == want
    assert token_files.token_table(docs.limit(0), path).collect() == []


def test_small_files(spark, docs):
    """Files that are closed often give the same rows."""
    folder = token_files.new_path(spark, "small")
    path = vocabulary_file("byte_bpe_50k.json")
    whole = token_files.FILE_TOKENS
    try:
        token_files.FILE_TOKENS = 300
        files = token_files.write_files(docs.repartition(1), folder, path)
    finally:
        token_files.FILE_TOKENS = whole
    got = sorted(tuple(r) for r in token_files.read_files(spark, folder, files).where("doc_id is not null").collect())
    assert got == sorted(tuple(r) for r in token_files.token_table(docs, path).where("doc_id is not null").collect())


def test_pieces_equal_the_library(docs):
    import sentencepiece

    path = vocabulary_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    coded = {r.doc_id: r.ids for r in pieces.encoded(docs, path).collect()}
    for k, text in enumerate(TEXTS):
        assert coded[k] == library.encode(text or ""), k
    back = {r.doc_id: r for r in pieces.decoded(pieces.encoded(docs, path), path).collect()}
    for k, text in enumerate(TEXTS):
        assert back[k].decoded == (text or "").replace("▁", " ")
    for r in pieces.round_trip(docs, path).collect():
        assert r.same == (r.doc_id != 6) and r.n_pieces == len(coded[r.doc_id])
    assert pieces.round_trip(docs.limit(0), path).collect() == []


def test_edges_are_all_occurrences():
    model = pieces.Model(vocabulary_file("piece_bpe_32k.model"))
    encoder = pieces.Encoder(model)
    data = "▁hello\0▁wörld▁▁".encode()
    want = sorted((k, len(p.encode()), i) for p, (i, _) in model.scores.items() for k in range(len(data)) if data[k:].startswith(p.encode()))
    assert sorted(zip(*(x.tolist() for x in encoder.edges(data)))) == want


def test_long_units_and_many_words(spark):
    """Texts without spaces, endless repeats, and words met again after being forgotten."""
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ["".join(rng.choice("日本語言葉文字漢学") for _ in range(5000)), "x" * 20_000, "ab" * 4000 + "é", "\x00".join("abc"), " lead", "a\n b\t\tc\r\nd "]
    texts += [" ".join("".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 9))) for _ in range(400)) for _ in range(40)]
    path = vocabulary_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = pieces.Encoder(pieces.Model(path))
    encoder.known.limit = 500
    for _ in range(2):
        for k in range(0, len(texts), 3):
            ids, counts = encoder(texts[k : k + 3])
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t) for t in texts[k : k + 3]]
    path = vocabulary_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = token_files.Encoder(f.read())
    own.words.limit = own.pieces.limit = 500
    for _ in range(2):
        for k in range(0, len(texts), 3):
            got = [np.frombuffer(x, own.kind).tolist() for x in own(texts[k : k + 3])]
            assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[k : k + 3]]


def test_pairs_are_kept_and_emptied():
    pairs = pieces.Pairs(bits=4)
    for start in range(0, 60, 6):
        keys = np.arange(start, start + 6) * 7
        assert pairs.find(keys)[1].all()
        pairs.add(keys, keys % 2 == 0)
        good, unknown = pairs.find(keys)
        assert not unknown.any() and (good == (keys % 2 == 0)).all() and pairs.held <= 8
