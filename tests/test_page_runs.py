"""Runs over all pages of a source, however many."""

import __spark_entry__ as entry


def test_a_run_goes_on_over_a_whole_source(spark, tmp_path):
    rows = [(k, "x" * 2600, "en", "ab"[k % 2]) for k in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("first_run", "tail_run"):
        found = entry.queries()[name](spark, str(tmp_path)).groupBy("source").count().collect()
        assert sorted(map(tuple, found)) == [("a", 120), ("b", 120)]
