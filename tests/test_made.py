"""Made queries beside their SQL on tables with copies, words alike and a book that ends early."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import normal


def differ(spark, folder, rows, *names):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    out, sql = [], entry.oracle_sql()
    for name in names:
        found = entry.queries()[name](spark, str(folder))
        columns = sorted(found.columns)
        cursor = con.execute(f"select {', '.join(columns)} from ({sql[name]})")
        if normal([tuple(r) for r in found.select(*columns).collect()]) != normal(cursor.fetchall()):
            out.append(name)
    return out


@pytest.mark.parametrize("last", [82, 90])
def test_contents_of_a_book_that_ends_early(spark, tmp_path, last):
    rows = [(k, f"text {k}", "en", "s") for k in range(last + 1)]
    assert differ(spark, tmp_path, rows, "made_contents", "made_contents_documents") == []


def test_headings_of_copies_and_of_a_book_that_ends_early(spark, tmp_path):
    rows = [(k, f"text {k // 8}", "en", "s") for k in range(75)]
    assert differ(spark, tmp_path, rows, "made_headings", "made_heading_report", "made_headings_unlike") == []
