"""Texts are cut to chunks once, and as word by word."""

import random
import re

from leafmill.operators import chunks


def test_texts_are_cut_once(spark):
    """No test on an array's size is inferred, which would cut every text again; pieces are those that joining word by word gives."""
    rng = random.Random(3)
    texts = ["\n".join(" ".join("x" * rng.randint(1, 12) + rng.choice(["", "", "."]) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 12))) for _ in range(40)] + ["", " \x1c ", None]
    rows = [("s", k, k, "t", x, ["s::a"], ["t"], None, []) for k, x in enumerate(texts)]
    held = spark.createDataFrame(rows, "source string, seq int, pdf_page int, title string, text string, section_ids array<string>, section_path array<string>, parent_section_id string, sibling_sections array<string>")
    for found in (chunks.section_chunks(held), chunks.paragraph_chunks(held, "seq")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("(?<=[.!?])") == 1
    got = {}
    for r in chunks.paragraph_chunks(held, "seq").orderBy("seq", "chunk_index").collect():
        got.setdefault(r.seq, []).append((r.chunk_total, r.text))
    for k, text in enumerate(texts):
        parts = [x for x in (p.strip() for p in re.split(r"(?<=[.!?])\s+", text or "")) if x]
        done, now, size = [], [], 0
        for part in parts:
            if now and size + len(part) + 1 > 700:
                done.append(now if size >= 200 else [*now, part])
                now, size = ([part], len(part)) if size >= 200 else ([], 0)
            else:
                now, size = [*now, part], size + len(part) + 1
        done += [now] if now else []
        assert got.get(k, []) == [(len(done), " ".join(x)) for x in done]


def test_lines_are_judged_once(spark):
    """Every line is stripped in one place, before the windows that tell segments and lists."""
    texts = spark.createDataFrame([("s", 1, "Препорука 9.1\nред\nТабела 2. Naslov\nпоље\n• a\n– b\n– c\nII. Kraj\nred")], "source string, seq int, text string")
    found = chunks.typed_lines(texts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line or "_w0" in line]
    assert windows and not any("regexp" in line.lower() or "rlike" in line.lower() for line in windows)
    got = [(r.rec_id, r.table_id, r.table_title, r.rec, r.tbl, r.list) for r in found.orderBy("line_no").collect()]
    none = (None,) * 3
    assert got == [("9.1", None, None, 1, None, None), (*none, 1, None, None), (None, "2", "Naslov", None, 1, None), (*none, None, 1, None), (*none, None, 1, 1), (*none, None, 1, 1), (*none, None, 1, 1), (*none, None, None, None), (*none, None, None, None)]


def test_pieces_are_never_broadcast(spark, tmp_path):
    """However small the stored texts' files are, the pieces cut from them stay where they are."""
    rows = [(f"s{k}", 1, 1, ["Naslov"], [f"s{k}::1"], "Naslov", None, [], f"Препорука 9.{k}\nSavet.\n• a\n• b\nKraj.") for k in range(20)]
    schema = "source string, seq int, pdf_page int, section_path array<string>, section_ids array<string>, title string, parent_section_id string, sibling_sections array<string>, text string"
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(str(tmp_path / "texts"))
    found = chunks.section_chunks(spark.read.parquet(str(tmp_path / "texts")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.groupBy("chunk_type").count().count() >= 2 and found.select("source").distinct().count() == 20
