"""Headings and lines, stored in small files, meet without a broadcast of what is made of them."""

import pytest

import __spark_entry__ as entry
from leafmill.operators import sections


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    """(sections, pages, contents pages), stored: each third page of a book has a heading."""
    folder = tmp_path_factory.mktemp("books")
    pages = [(f"b{k}", page, f"{'abcdefghi'[page - 1] * 12} {'jklmnopqr'[page - 1] * 12} naslov\nred {page}") for k in range(20) for page in range(1, 10)]
    wanted = [(f"b{k}", n, None, None, f"{'cfi'[n - 1] * 12} {'lor'[n - 1] * 12} naslov", 1) for k in range(20) for n in range(1, 4)]
    tables = {"sections": (wanted, "source string, seq int, marker_text string, id string, title string, level int"), "pages": (pages, "source string, page int, text string"), "located": ([("b0", 1)], "source string, page int")}
    out = []
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan, "Broadcast" in plan


def test_sections_meet_their_pages_by_merge_joins(books):
    found, _ = sections.heading_pages(*books)
    assert joins(found) == (True, False)
    assert sorted((r.source, r.seq, r.pdf_page) for r in found.collect()) == sorted((f"b{k}", n, 3 * n) for k in range(20) for n in range(1, 4))


def test_reports_are_put_together_by_merge_joins(books):
    _, report = sections.heading_pages(*books)
    assert joins(report) == (True, False)
    assert sorted((r.source, r.headings_total, r.headings_found) for r in report.collect()) == sorted((f"b{k}", 3, 3) for k in range(20))


def test_report_of_a_book_that_lost_no_heading(spark, tmp_path):
    """Null where nothing is lost, as in the SQL."""
    spark.createDataFrame([(k, f"text {k}", "en", "s") for k in range(60)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.source: r for r in entry.queries()["made_heading_report"](spark, str(tmp_path)).collect()}
    assert found["b0"].lost and found["b0"].skipped and found["b0"].total == 9
    assert (found["b1"].total, found["b1"].found, found["b1"].lost, found["b1"].skipped) == (2, 2, None, None)


def test_lines_and_targets_meet_by_merge_joins(spark, tmp_path):
    """As they are, as a beginning, by words and by likeness; each target is met once for each length that is like it."""
    lines = [(f"b{k}", page, f"{'abcdefghi'[page - 1] * 40} naslov") for k in range(20) for page in range(1, 10)]
    targets = [(f"b{k}", n, f"{'cfi'[n - 1] * 39}x naslov", 0.8) for k in range(20) for n in range(1, 4)]
    for name, rows, schema in (("lines", lines, "source string, page int, line string"), ("targets", targets, "source string, seq int, target string, least double")):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{tmp_path}/{name}")
    met = sections.heading_hits(*(spark.read.parquet(f"{tmp_path}/{name}") for name in ("targets", "lines")))
    assert joins(met) == (True, False)
    assert sorted(map(tuple, met.collect())) == sorted((f"b{k}", n, 3 * n) for k in range(20) for n in range(1, 4))
