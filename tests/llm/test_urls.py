"""URL filters: parsing, rules, classes of aliases, and the SQL beside them."""

import pytest

from leafmill.llm import urls

CANON = '<html><head><link rel="canonical" href="{}"></head>'
BACK = "<link href='{}' rel='canonical'>"
GO = '<meta http-equiv="refresh" content="0; url={}">'
PAGES = [
    (1, "http://WWW.Example.com/en/a?x=1#f", None),
    (2, "https://sub.example.com/en/b", ""),
    (3, "https://free.org/one", CANON.format("https://sub.example.com/en/b")),
    (4, "https://free.org/two", BACK.format("https://free.org/one#top")),
    (5, "https://www.example.com/en/c", CANON.format("/en/d")),
    (6, "https://free.org/three", GO.format("//free.org/two")),
    (7, "https://alone.org/x", CANON.format("https://other.org/y")),
    (8, "nonsense", CANON.format("https://sub.example.com/en/b")),
    (9, None, None),
    (10, "x://host.net?q=/es/", None),
    (11, "x://host.net/es/p", None),
    (12, "ftp://a.com", None),
    (13, "ftp://a.com/", None),
    (14, "https://hub.org/", CANON.format("https://new.net/fr/z")),
    (14, "https://hub.org/", CANON.format("https://new.net/fr/z")),
    (None, "https://HUB.org/#frag", "x"),
    (15, "https://exampleXcom/en/", None),
    (16, "://host.example.com/en/", "<LINK REL=canonical HREF=http://hub.org/>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash", "clash") for r in PAGES], "page_id long, url string, html string, host string, verdict string").repartition(3)


def test_parts_rules_and_classes(pages):
    got = {r.page_id: tuple(r)[1:] for r in urls.filtered(pages).collect()}
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[2] == ("sub.example.com", "/en/b", "example.com/en/", "block")
    assert [got[k][3] for k in (3, 4, 6)] == ["block"] * 3 and got[3][2] is None
    assert got[5][3] == "allow" and got[7] == ("alone.org", "/x", None, "allow")
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow")
    assert got[10] == ("host.net", "", None, "allow") and got[11] == ("host.net", "/es/p", "net/es/", "block")
    assert got[12] == ("a.com", "", None, "allow") and got[13] == ("a.com", "/", "com/", "allow")
    assert got[14][3] == "block" and got[None][3] == "block" and got[15] == ("examplexcom", "/en/", None, "allow")
    assert got[16] == ("host.example.com", "/en/", "example.com/en/", "block")


def test_own_allow_stands(spark):
    rows = [(1, "http://www.example.com/en/q", CANON.format("http://bad.net/es/")), (2, "http://plain.org/", CANON.format("http://www.example.com/en/q"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.filtered(df).collect()} == {1: "allow", 2: "block"}


def test_long_rule_tables_are_joined(spark, pages):
    table = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(urls.filtered(pages, table)) == key(urls.filtered(pages))


def test_against_sql(pages):
    import duckdb

    con = duckdb.connect()
    con.register("pages_df", pages.select("page_id", "url", "html").toPandas())
    con.execute("create view pages as select cast(page_id as bigint) as page_id, url, html from pages_df where html is null or html not ilike '%refresh%'")
    want = con.execute(urls.oracle()).fetchall()
    kept = pages.where("html is null or lower(html) not like '%refresh%'")
    got = [tuple(r) for r in urls.filtered(kept).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty_table(pages):
    assert urls.filtered(pages.limit(0)).collect() == []


def test_quoted_refreshes_and_all_links_of_a_page(spark):
    bad = "http://bad.net/es/"
    html = {
        1: f"""<meta http-equiv="refresh" content="0;url='{bad}'">""",
        2: f"""<meta http-equiv='refresh' content='0; URL = "{bad}"'>""",
        3: GO.format("/else") + GO.format(bad),
        4: CANON.format("/else") + BACK.format(bad),
        5: f"<meta http-equiv=refresh content=0;url={bad}>",
        6: GO.format("http://good.org/"),
        7: f"""<meta http-equiv="refresh" content="0"><a href="x?url={bad}">""",
    }
    df = spark.createDataFrame([(k, f"http://p{k}.org/", x) for k, x in html.items()], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.filtered(df).collect()} == {k: "block" if k < 6 else "allow" for k in html}
