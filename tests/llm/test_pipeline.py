"""The pipeline's stages on small tables: what goes, what stays, what changes."""

import random

import corpus_pipeline
from tests.llm.test_language import PARTS, sentence


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, sentence(rng, lang := rng.choice(list(PARTS)), 80), lang) for k in range(300)]
    item = sentence(random.Random(77), "aa", 30)
    rows += [(300, rows[5][1], "aa"), (301, rows[5][1] + " extra", "aa"), (302, "12345 67890", "aa"), (303, None, None)]
    rows += [(304, rows[6][1] + " " + item + " " + rows[7][1], "aa"), (305, (lone := sentence(rng, "bb", 60)) + " password: abcdefgh1234", "bb")]
    docs = spark.createDataFrame([(k, t, x, "s", len(t or "")) for k, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "sentence_pieces"]
    held, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, str(tmp_path))
        if name != "sentence_pieces":
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        held = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in held.collect()}
    assert {302, 303} == {k for k, *_ in rows} - set(seen["language_id"])
    gone = set(seen["language_id"]) - set(seen["near_dedup"])
    assert gone == {300, 301}
    assert set(seen["near_dedup"]) - set(seen["decontamination"]) == {304}
    assert seen["secret_scan"][305].text == lone + " [SECRET]" and seen["secret_scan"][305].n_chars == len(seen["secret_scan"][305].text)
    assert set(seen["secret_scan"]) == set(seen["decontamination"]) == set(seen["sentence_pieces"])
    assert all(r.same and r.decoded == seen["secret_scan"][k].text and r.n_pieces == len(r.ids) for k, r in seen["sentence_pieces"].items())
    whole = {r.doc_id: r.n_pieces for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {k: r.n_pieces for k, r in seen["sentence_pieces"].items()}


def test_empty_input_of_each_stage(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null and repeated ids, repeated rows, null, empty and very long texts, columns with the operators' own names."""
    rng = random.Random(5)
    text = lambda n=60: sentence(rng, rng.choice(list(PARTS)), n)
    rows = [(k if k % 9 else None, text()) for k in range(200)]
    twice, long = text(), text(40_000)
    rows += [(500, twice)] * 3 + [(501, None), (502, ""), (503, long), (None, long), (504, "12 34"), (7, text()), (7, text())]
    own = ["item_id", "fp", "spans", "ids", "decoded", "node", "share", "secret_spans", "_k"]
    docs = spark.createDataFrame([(k, x, "aa" if k is None or k % 2 else None, None, len(x or ""), *own) for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in own))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, sentence(random.Random(9), "bb", 30)), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    held, counts = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, str(tmp_path))
        assert name == "sentence_pieces" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"{k}"))
        held = spark.read.parquet(str(tmp_path / f"{k}"))
        counts.append(held.count())
    texts = {x for _, x in rows}
    kept = spark.read.parquet(str(tmp_path / "3")).collect()
    assert {r.text for r in kept} <= texts and not {None, "", "12 34"} & {r.text for r in kept}
    assert sum(r.text == twice for r in kept) == 1 and sum(r.text == long for r in kept) == 1
    assert all([r[c] for c in own] == own for r in kept)
    assert counts[-1] == counts[-2] and all(r.same for r in held.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]
