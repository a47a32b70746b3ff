"""The jobs: growing input, broken batches, repeated runs, the command lines."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException

from jobs import common, question_bank, refresh_chunks

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, lang string, source string, extra string"
TURNS = "conv_id long, turn int, role string, text string"


def prose(k, n=30):
    return " ".join(f"Sentence {k} number {i} has some words in it." for i in range(n))


def put(spark, rows, folder, name, schema=DOCS):
    """One more Parquet file in a folder, as a writer elsewhere would leave it."""
    path = Path(folder) / name
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path) + ".tmp")
    path.parent.mkdir(parents=True, exist_ok=True)
    next(Path(str(path) + ".tmp").glob("*.parquet")).rename(str(path) + ".parquet")


def index(spark, out):
    return {(r.doc_id, r.chunk_index): (r.text, r.lang, r.source, r.chunk_id) for r in refresh_chunks.current_chunks(spark, out).collect()}


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")


def first_rows():
    return [(1, prose(1), "en", "a", "x"), (2, prose(2), None, "a", "x"), (3, "short", "en", "b", "x"), (4, None, "en", "b", "x"), (None, prose(5), "en", "b", "x"), (6, prose(6), " ", None, "x"), (6, prose(6), " ", None, "x")]


def test_a_second_run_takes_only_what_is_new(spark, place):
    documents, out, mark = place
    put(spark, first_rows(), documents, "one")
    told = refresh_chunks.refresh(spark, documents, out, mark)
    assert (told["n_batches"], told["n_read"], told["n_without_id"], told["n_taken"]) == (1, 7, 1, 5)
    before = index(spark, out)
    assert {k for k, _ in before} == {1, 2, 6}
    assert {v[1] for k, v in before.items() if k[0] in (2, 6)} == {"und"}
    assert before[1, 0][3] == "a::1::p::c0" and before[6, 0][3] == "6::p::c0"

    again = refresh_chunks.refresh(spark, documents, out, mark)
    assert again == dict.fromkeys(again, 0) and index(spark, out) == before

    # one is as before, two has grown, three has become long, seven is new
    put(spark, [(1, prose(1), "en", "a", "x"), (2, prose(2, 60), "de", "a", "x"), (3, prose(3), "en", "b", "x"), (7, prose(7), "fr", "c", "x")], documents, "two")
    told = refresh_chunks.refresh(spark, documents, out, mark)
    assert (told["n_batches"], told["n_read"], told["n_taken"]) == (1, 4, 3)
    after = index(spark, out)
    assert {k: v for k, v in after.items() if k[0] in (1, 6)} == {k: v for k, v in before.items() if k[0] in (1, 6)}
    assert {k for k, _ in after} == {1, 2, 3, 6, 7}
    assert {v[1] for k, v in after.items() if k[0] == 2} == {"de"}
    assert " ".join(after[2, k][0] for k in range(sum(d == 2 for d, _ in after))) == prose(2, 60)
    assert refresh_chunks.table(spark, out, "marks", refresh_chunks.MARK).count() == 2

    # a document that becomes short loses its chunks
    put(spark, [(7, "gone", "fr", "c", "x")], documents, "three")
    refresh_chunks.refresh(spark, documents, out, mark)
    assert {k for k, _ in index(spark, out)} == {1, 2, 3, 6}


def test_growing_input_ends_as_one_run_over_all(spark, place, tmp_path):
    documents, out, mark = place
    rows = [(k, prose(k, 5 + k % 30), "en" if k % 3 else "de", f"s{k % 4}", "x") for k in range(60)]
    config = refresh_chunks.Config(files_per_batch=1, rows_per_file=10)
    for at in range(0, 60, 20):
        put(spark, rows[at : at + 10], documents, f"f{at}")
        put(spark, rows[at + 10 : at + 20], documents, f"g{at}")
        assert refresh_chunks.refresh(spark, documents, out, mark, config)["n_batches"] == 2
    put(spark, rows, str(tmp_path / "whole"), "all")
    refresh_chunks.refresh(spark, str(tmp_path / "whole"), str(tmp_path / "o"), str(tmp_path / "m"))
    assert index(spark, out) == index(spark, str(tmp_path / "o"))


def test_a_broken_batch_is_done_again(spark, place, monkeypatch):
    documents, out, mark = place
    put(spark, first_rows(), documents, "one")
    refresh_chunks.refresh(spark, documents, out, mark)
    before = index(spark, out)
    put(spark, [(1, prose(11), "en", "a", "x"), (9, prose(9), "en", "a", "x")], documents, "two")
    whole = refresh_chunks.chunked

    def breaks(*given):
        raise OSError("lost")

    monkeypatch.setattr(refresh_chunks, "chunked", breaks)
    with pytest.raises(StreamingQueryException):
        refresh_chunks.refresh(spark, documents, out, mark)
    assert index(spark, out) == before  # the batch has documents, but no mark
    monkeypatch.setattr(refresh_chunks, "chunked", whole)
    assert refresh_chunks.refresh(spark, documents, out, mark)["n_taken"] == 2
    assert {k for k, _ in index(spark, out)} == {1, 2, 6, 9} and "Sentence 11 " in index(spark, out)[1, 0][0]


def test_vectors_of_what_is_new_alone_and_a_search_in_them(spark, place):
    from leafmill.operators import retrieval
    from leafmill.sources import models

    documents, out, mark = place
    config = refresh_chunks.Config(encoder="hashing")
    put(spark, first_rows(), documents, "one")
    refresh_chunks.refresh(spark, documents, out, mark, config)
    put(spark, [(1, "zebra quagga okapi tapir. " * 10, "en", "a", "x"), (6, prose(6), "en", "a", "x")], documents, "two")
    refresh_chunks.refresh(spark, documents, out, mark, config)
    vectors = refresh_chunks.current_vectors(spark, out)
    chunks = {r.chunk_id: (r.doc_id, r.batch) for r in refresh_chunks.current_chunks(spark, out).collect()}
    assert {r.chunk_id: (r.doc_id, r.batch) for r in vectors.collect()} == chunks
    assert spark.read.parquet(f"{out}/vectors/batch=1").select("doc_id").distinct().collect() == [(1,)]
    asked = models.embedded(spark.createDataFrame([(1, "okapi tapir zebra quagga.")], "qid long, query string"), models.HashingEncoder, "query")
    best = retrieval.top_k(asked, vectors.where("doc_id is not null").withColumn("id", vectors.doc_id), 1).first()
    assert best.id == 1


def test_an_output_of_another_checkpoint_is_refused(spark, place, tmp_path):
    documents, out, mark = place
    config = refresh_chunks.Config(files_per_batch=1)
    put(spark, first_rows(), documents, "one")
    put(spark, [(9, prose(9), "en", "a", "x")], documents, "two")
    refresh_chunks.refresh(spark, documents, out, mark, config)
    with pytest.raises(StreamingQueryException, match="another checkpoint"):
        refresh_chunks.refresh(spark, documents, out, str(tmp_path / "other"), config)


def test_of_one_id_in_a_batch_the_largest_digest_is_taken(spark, place):
    import hashlib

    documents, out, mark = place
    texts = [prose(k) for k in range(40)]
    put(spark, [(1, x, "en", "a", "x") for x in texts] * 3, documents, "one")
    assert refresh_chunks.refresh(spark, documents, out, mark)["n_taken"] == 1
    best = max(texts, key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    assert " ".join(v[0] for _, v in sorted(index(spark, out).items())) == best


INTENTS = {"cause": ["why"], "amount": ["how much", "how many"], "rest": []}


def turns(spark, path, rows):
    spark.createDataFrame(rows, TURNS).write.mode("overwrite").parquet(path)
    return path


def bank(spark, out, name="bank", snapshot="current"):
    return sorted(question_bank.read_back(spark, out, snapshot, name).collect(), key=str)


def conversation():
    return [
        (1, 0, "user", "Why is it so?"), (1, 1, "assistant", "Because."),
        (2, 0, "system", "Be kind."), (2, 1, "user", "  why is   it SO "), (2, 2, "assistant", "Because it is so."),
        (3, 0, "user", "How many are there?"), (3, 0, "user", "How many are there?"), (3, 2, "assistant", "too late"),
        (4, 0, "user", "?!"), (4, 1, "user", None), (None, 0, "user", "why"), (5, None, "assistant", "x"),
        (6, 0, "user", "why is it so"), (6, 1, "assistant", "Because it is no."),
    ]


def test_equal_questions_are_one_with_the_longest_answer(spark, tmp_path):
    path, out = turns(spark, str(tmp_path / "t"), conversation()), str(tmp_path / "out")
    config = question_bank.Config(intents=INTENTS, top=1)
    told = question_bank.build(spark, path, out, config)
    assert told == {"n_user_turns": 7, "n_without_place": 2, "n_questions": 2}
    found = {r.query_key: r for r in bank(spark, out)}
    why, many = found["why is it so"], found["how many are there"]
    assert (why.intent, why.answer, why.conv_id, why.turn, why.first_conv, why.first_turn, why.n_asked, why.n_conversations) == ("cause", "Because it is so.", 2, 1, 1, 0, 3, 3)
    assert (many.intent, many.answer, many.n_asked, many.n_conversations) == ("amount", None, 2, 1)
    assert [tuple(r) for r in bank(spark, out, "report")] == [("amount", 1, 2, 0, 400), ("cause", 1, 3, 1, 600), ("rest", 0, 0, 0, 0)]
    assert [(r.rank, r.query_key) for r in bank(spark, out, "top")] == [(1, "how many are there"), (1, "why is it so")]


def test_reruns_give_the_same_and_leave_other_snapshots(spark, tmp_path):
    out = str(tmp_path / "out")
    one, two = (question_bank.Config(intents=INTENTS, snapshot=x) for x in ("one", "two"))
    first = turns(spark, str(tmp_path / "t"), conversation())
    question_bank.build(spark, first, out, one)
    held = [bank(spark, out, name, "one") for name in ("bank", "report", "top")]
    fewer = turns(spark, str(tmp_path / "u"), conversation()[:2])
    for _ in range(2):
        question_bank.build(spark, fewer, out, two)
        assert [r.query_key for r in bank(spark, out, "bank", "two")] == ["why is it so"]
    question_bank.build(spark, first, out, one)
    assert [bank(spark, out, name, "one") for name in ("bank", "report", "top")] == held
    # fewer intents than before: no partition of the former run is left
    question_bank.build(spark, fewer, out, one)
    assert [r.intent for r in bank(spark, out, "bank", "one")] == ["cause"]


def test_empty_tables(spark, tmp_path):
    out = str(tmp_path / "out")
    question_bank.build(spark, turns(spark, str(tmp_path / "t"), []), out, question_bank.Config(intents=INTENTS))
    assert bank(spark, out) == [] and bank(spark, out, "top") == []
    assert [tuple(r) for r in bank(spark, out, "report")] == [("amount", 0, 0, 0, 0), ("cause", 0, 0, 0, 0), ("rest", 0, 0, 0, 0)]


def test_settings_are_checked(spark, tmp_path):
    for kind, name in ((refresh_chunks.Config, "refresh_chunks"), (question_bank.Config, "question_bank")):
        assert isinstance(common.read_config(spark, kind, str(ROOT / "jobs" / f"{name}.json")), kind)
    (tmp_path / "c.json").write_text(json.dumps({"min_char": 3}))
    with pytest.raises(ValueError, match="min_char;"):
        common.read_config(spark, refresh_chunks.Config, str(tmp_path / "c.json"))


def test_command_lines(spark, place, tmp_path):
    documents, out, mark = place
    put(spark, first_rows(), documents, "one")
    turns(spark, str(tmp_path / "t"), conversation())
    runs = [
        ["jobs.refresh_chunks", "--documents", documents, "--output", out, "--checkpoint", mark, "--config", "jobs/refresh_chunks.json"],
        ["jobs.question_bank", "--conversations", str(tmp_path / "t"), "--output", str(tmp_path / "b"), "--config", "jobs/question_bank.json"],
    ]
    for run in runs:
        said = subprocess.run([sys.executable, "-m", *run], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True).stderr
        assert f"wrote " in said and run[0].split(".")[1] in said
    assert {k for k, _ in index(spark, out)} == {1, 2, 6}
    assert len(bank(spark, str(tmp_path / "b"))) == 2


@pytest.mark.parametrize("name", ["job1_refresh_chunks", "job2_question_bank"])
def test_queries_equal_their_sql(spark, name):
    from jobs import queries

    from .compare import compare

    assert compare(spark, "/root/testdata/sf0.001", name, queries.queries()[name], queries.oracle_sql()[name]) == ""
