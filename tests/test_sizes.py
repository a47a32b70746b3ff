"""What stands on which side of a join or window, and what follows for large tables."""

import numpy as np
from pyspark.sql import functions as F

from leafmill.operators import cells, questions

FORMS = "seq int, id string, template string, intent string, requires array<string>"
RECORDS = "chunk_id string, source string, pdf_page int, section_path array<string>, section_ids array<string>, entities map<string,array<string>>"


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_chunks_are_not_broadcast_to_templates(spark):
    records = spark.createDataFrame([(str(k), "s", 1, [], [], {"a": [f"v{k}"], "b": ["ww"]}) for k in range(20)], RECORDS)
    templates = spark.createDataFrame([(1, "t1", "What of {a} and {b}?", "precise", ["a", "b"])], FORMS)
    made = questions.generated(records, templates)
    before = plan_of(made).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    # a hint stands in the plan, so no size of the chunks' file has them broadcast
    assert "rightHint=(strategy=broadcast)" in before
    assert made.count() == 20


def test_equal_questions_meet_in_aggregates(spark):
    rows = spark.createDataFrame([("s", n, "What is x?", size) for n, size in enumerate([1, None, 3, 3])], "source string, n int, query string, size int")
    kept = questions.deduplicated(rows, ["n"], ["source"], F.col("size"))
    assert "Window" not in plan_of(kept)
    assert [(r.n, r._first.n) for r in kept.collect()] == [(2, 0)]


def test_rows_of_a_packer_go_on_few_at_a_time():
    rows = [(k, np.arange(8), np.zeros(8 << 16), np.zeros(8)) for k in range(6)]
    sent = list(cells._batches(iter(rows), ["cell", "ids", "vectors", "distances"]))
    assert [len(x) for x in sent] == [1] * 6
    small = [(k, np.arange(2), np.zeros(8), np.zeros(2)) for k in range(6)]
    assert [len(x) for x in cells._batches(iter(small), ["cell", "ids", "vectors", "distances"])] == [6]
