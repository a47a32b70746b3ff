"""Driver queries of the engine's own operators, with their SQL.

The driver's tables stand in for pages, lines, chunks, questions and vectors: a
document is a page of a book of fifty, lines are a document's lines, events per
user are lines in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as t
from .operators import chunks, entities, pages, questions, retrieval, runs, sections, stats, toc
from .packs import LanguagePack, Settings
from .sources import writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, fifty to a book, so that there are the more books the larger the table is."""
    docs = table(spark, sf_dir, "documents")
    book, page = F.concat(F.lit("b"), F.floor(F.col("doc_id") / 50).cast("string")), (F.col("doc_id") % 50 + 1).cast("int")
    held = docs.select(book.alias("source"), page.alias("page"), "text", F.length("text").alias("n_chars"), "doc_id")
    # the test table is one file of one row group; a book's pages are dealt out together
    return held.repartition("source")


def as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(t.lines_of(F.col("text"))).alias("k", "line")).select("doc_id", (F.col("k") + 1).alias("line_no"), "line")


def md5(x: Column) -> Column:
    return F.md5(x.cast("binary"))


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
PAGES = "pages_of AS (SELECT 'b' || (doc_id // 50) AS source, CAST(doc_id % 50 + 1 AS INTEGER) AS page, text, length(text) AS n_chars, doc_id FROM documents)"
STRIP = r"regexp_replace({}, '^[\s\v]+|[\s\v]+$', '', 'g')"
WORD = r"\p{L}\p{N}\p{M}_"
MARKED = (
    r"regexp_matches(s, '^(\d{1,2}\.\d{1,2}\.\d{1,2})\.?\s{1,4}.+$') OR regexp_matches(s, '^(\d{1,2}\.\d{1,2})\.?\s{1,4}.+$') OR regexp_matches(s, '^(I{1,3}|IV|V|VI{0,3}|IX|X{1,3})\.?\s{1,6}.+$')"
    r" OR regexp_matches(s, '^\d{1,2}\.\s{1,4}.+$') OR regexp_matches(s, '^[A-ZА-ШЂЈЉЊЋЏ]\.\s{1,3}.+$') OR regexp_matches(s, '^[a-zа-шђјљњћџ]\.\s{1,3}.+$')"
    rf" OR regexp_matches(s, '(?i)^(ПОГЛАВЉЕ|POGLAVLJE)\s+\d+\.\s*.+$') OR regexp_matches(s, '^[^{WORD}\s]+\s+.+$')"
)
TOC_LINE = rf"(s <> '' AND length(s) <= 150 AND ({MARKED} OR (length(s) < 120 AND NOT regexp_matches(s, '[.!?]$') AND NOT regexp_full_match(s, '\d{{1,3}}'))))"


# --- pages and lines ---


@query(rf"""
WITH c AS (SELECT doc_id, {STRIP.format(r"regexp_replace(text, '[ \t\r\f\v]+(\n|$)', '\1', 'g')")} AS text FROM documents)
SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM c WHERE length(text) >= 100""")
def page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.clean_pages(as_pages(spark, sf_dir)).select("doc_id", "n_chars", md5(F.col("text")).alias("digest"))


@query(f"""
WITH {PAGES}
SELECT source, count(*) AS n_pages, min(n_chars) AS min_chars, max(n_chars) AS max_chars, CAST(floor(sum(n_chars) / count(*)) AS BIGINT) AS mean_chars, CAST(sum(n_chars) AS BIGINT) AS total_chars
FROM pages_of GROUP BY ROLLUP (source)""")
def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_stats(as_pages(spark, sf_dir))


@query(rf"""
WITH {LINES}, x AS (SELECT doc_id, line_no, line, {STRIP.format("line")} AS s FROM lines)
SELECT doc_id, line_no, {TOC_LINE} AS toc_line,
  length(s) >= 50 AND regexp_matches(s, '^[\p{{Lu}}\p{{Nd}}„«("'']') AND regexp_matches(s, '[.!?]') AS sentence_line,
  length(lead(line) OVER (PARTITION BY doc_id ORDER BY line_no)) AS next_length
FROM x""")
def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = as_lines(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.select("doc_id", "line_no", t.is_toc_line(F.col("line")).alias("toc_line"), t.is_sentence_line(F.col("line")).alias("sentence_line"), F.length(F.lead("line").over(w)).alias("next_length"))


@query(rf"""
WITH {LINES}, x AS (SELECT doc_id, {STRIP.format("line")} AS s FROM lines),
y AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({TOC_LINE}) AS listed FROM x WHERE s <> '' GROUP BY doc_id)
SELECT doc_id, n_lines, round(listed / n_lines, 6) AS toc_ratio FROM y""")
def toc_page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = toc.page_flags(as_pages(spark, sf_dir))
    return flagged.where("n_lines > 0").select("doc_id", "n_lines", F.round("toc_ratio", 6).alias("toc_ratio"))


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the pages of their sources."""
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf_dir, "documents").select("source", F.row_number().over(w).alias("page"), F.length("text").alias("n_chars"))


SOURCE_PAGES = "pages_of AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, text, length(text) AS n_chars, doc_id FROM documents)"
RUN = """
WITH {pages}, m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page {by}) AS nth FROM pages_of),
f AS (SELECT *, min(CASE WHEN n_chars >= 2500 THEN nth END) OVER (PARTITION BY source) AS a FROM m),
g AS (SELECT *, min(CASE WHEN nth > a AND n_chars < 800 THEN nth END) OVER (PARTITION BY source) AS z FROM f)
SELECT source, page, n_chars FROM g WHERE nth >= a AND (z IS NULL OR nth < z)"""


@query(RUN.format(pages=SOURCE_PAGES, by="ASC"))
def first_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = source_pages(spark, sf_dir)
    return runs.first_run(held, ["source"], [F.asc("page")], F.col("n_chars") >= 2500, F.col("n_chars") >= 800).select("source", "page", "n_chars")


@query(RUN.format(pages=SOURCE_PAGES, by="DESC"))
def tail_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = source_pages(spark, sf_dir)
    return runs.first_run(held, ["source"], [F.desc("page")], F.col("n_chars") >= 2500, F.col("n_chars") >= 800).select("source", "page", "n_chars")


# --- sections ---


@query(f"""
WITH {LINES}, e AS (SELECT doc_id, line_no AS seq, 'f' || (length(line) % 7) AS family FROM lines),
f AS (SELECT *, min(seq) OVER (PARTITION BY doc_id, family) AS first FROM e)
SELECT doc_id, seq, family, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS level FROM f""")
def family_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = as_lines(spark, sf_dir).select(F.col("doc_id").alias("source"), F.col("line_no").alias("seq"), F.concat(F.lit("f"), (F.length("line") % 7).cast("string")).alias("family"))
    return toc.family_levels(lines).select(F.col("source").alias("doc_id"), "seq", "family", "level")


@query(f"""
WITH {LINES}, e AS (SELECT doc_id, line_no AS seq, 1 + length(line) % 3 AS level FROM lines),
p AS (SELECT a.doc_id, a.seq, max(b.seq) AS parent_seq FROM e a LEFT JOIN e b ON a.doc_id = b.doc_id AND b.seq < a.seq AND b.level < a.level GROUP BY 1, 2)
SELECT e.doc_id, e.seq, e.level, p.parent_seq FROM e JOIN p USING (doc_id, seq)""")
def section_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = as_lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("seq"), (1 + F.length("line") % 3).alias("level"))
    return sections.ancestors(lines, ["doc_id"]).select("doc_id", "seq", "level", "parent_seq")


def toy_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth page begins a section of its source; some have no page."""
    held = as_pages(spark, sf_dir).where("page % 5 = 1")
    w = Window.partitionBy("source").orderBy("page")
    n = F.row_number().over(w)
    title = F.regexp_extract("text", r"^(\S+ \S+)", 1)
    return held.select("source", n.alias("seq"), F.when(n % 4 != 0, F.col("page")).alias("pdf_page"), title.alias("title"), F.when(n % 3 == 0, n.cast("string")).alias("id"), (1 + n % 3).cast("int").alias("level"), F.lit(None).cast("string").alias("marker_text"))


@query(rf"""
WITH {PAGES}, s AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY page) AS seq, page FROM pages_of WHERE page % 5 = 1),
m AS (SELECT source, seq, CASE WHEN seq % 4 <> 0 THEN page END AS pdf_page FROM s),
r AS (SELECT *, first_value(pdf_page IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM m)
SELECT r.source, seq, pdf_page, md5(string_agg(text, chr(10) ORDER BY page)) AS digest
FROM r JOIN pages_of p ON r.source = p.source AND page >= pdf_page AND (next IS NULL OR page < next) GROUP BY 1, 2, 3""")
def section_range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.section_text(toy_sections(spark, sf_dir).select("source", "seq", "pdf_page"), as_pages(spark, sf_dir))
    return found.select("source", "seq", "pdf_page", md5(F.col("text")).alias("digest"))


SLUG = r"trim(substr(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g'), '\s+', '_', 'g'), 1, 30), '_')"
PARTS = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format('x')}), lambda x: x <> '')"


@query(rf"""
WITH RECURSIVE {PAGES}, n AS (SELECT source, page, row_number() OVER (PARTITION BY source ORDER BY page) AS seq, regexp_extract(text, '^(\S+ \S+)', 1) AS title FROM pages_of WHERE page % 5 = 1),
o AS (SELECT *, CASE WHEN seq % 4 <> 0 THEN page END AS pdf_page, coalesce(CASE WHEN seq % 3 = 0 THEN CAST(seq AS VARCHAR) END, nullif({SLUG.format('title')}, ''), 'S' || (seq - 1)) AS own FROM n),
h AS (SELECT *, CASE WHEN seq % 3 = 0 OR seq = 1 THEN 1 WHEN seq % 3 = 1 OR seq = 2 THEN 2 ELSE 3 END AS depth, lag(own) OVER w AS own1, lag(own, 2) OVER w AS own2, lag(title) OVER w AS title1, lag(title, 2) OVER w AS title2,
  first_value(pdf_page IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM o WINDOW w AS (PARTITION BY source ORDER BY seq)),
i AS (SELECT *, source || '::' || CASE depth WHEN 1 THEN own WHEN 2 THEN own1 || '.' || own ELSE own2 || '.' || own1 || '.' || own END AS id,
  CASE depth WHEN 1 THEN '' WHEN 2 THEN source || '::' || own1 || ' > ' ELSE source || '::' || own2 || ' > ' || source || '::' || own2 || '.' || own1 || ' > ' END AS above,
  CASE depth WHEN 1 THEN title WHEN 2 THEN title1 || ' > ' || title ELSE title2 || ' > ' || title1 || ' > ' || title END AS path FROM h),
r AS (SELECT source, list(id ORDER BY seq) AS roots FROM i WHERE depth = 1 GROUP BY 1),
x AS (SELECT i.source, i.seq, string_agg(p.text, chr(10) ORDER BY p.page) AS text FROM i JOIN pages_of p ON i.source = p.source AND p.page >= i.pdf_page AND (i.next IS NULL OR p.page < i.next) GROUP BY 1, 2),
s AS (SELECT source, seq, {PARTS} AS parts FROM (SELECT source, seq, {STRIP.format('text')} AS text FROM x) WHERE text <> ''),
f(source, seq, parts, i, done, now, size, n) AS (
  SELECT source, seq, parts, 0, CAST([] AS VARCHAR[]), '', 0, 0 FROM s
  UNION ALL
  SELECT source, seq, parts, i + 1,
    CASE WHEN closes THEN list_append(done, CASE WHEN size >= 200 THEN now ELSE now || ' ' || x END) ELSE done END,
    CASE WHEN closes THEN CASE WHEN size >= 200 THEN x ELSE '' END WHEN n > 0 THEN now || ' ' || x ELSE x END,
    CAST(CASE WHEN closes THEN CASE WHEN size >= 200 THEN len(x) ELSE 0 END ELSE size + len(x) + 1 END AS INTEGER),
    CASE WHEN closes THEN CASE WHEN size >= 200 THEN 1 ELSE 0 END ELSE n + 1 END
  FROM (SELECT *, n > 0 AND size + len(x) + 1 > 700 AS closes FROM (SELECT *, parts[i + 1] AS x FROM f WHERE i < len(parts)))),
e AS (SELECT source, seq, CASE WHEN n > 0 THEN list_append(done, now) ELSE done END AS chunks FROM f WHERE i = len(parts)),
k AS (SELECT *, unnest(generate_series(1, len(chunks))) AS k FROM e)
SELECT source || '::' || id || '::p' || pdf_page || '::p::c' || (k - 1) AS chunk_id, source, pdf_page, above || id AS section_ids, path AS section_path, 'paragraph' AS chunk_type, k - 1 AS chunk_index, len(chunks) AS chunk_total,
  CASE WHEN depth = 1 THEN array_to_string(list_filter(roots, lambda y: y <> id), ',') ELSE '' END AS sibling_sections, '' AS related_lists, md5(chunks[k]) AS digest
FROM k JOIN i USING (source, seq) JOIN r USING (source)""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole chunking of sections: hierarchy, text, kinds, links."""
    found = chunks.document_chunks(toy_sections(spark, sf_dir), as_pages(spark, sf_dir))
    joined = [F.array_join(c, by).alias(c) for c, by in (("section_ids", " > "), ("section_path", " > "), ("sibling_sections", ","), ("related_lists", ","))]
    return found.select("chunk_id", "source", "pdf_page", "chunk_type", "chunk_index", "chunk_total", *joined, md5(F.col("text")).alias("digest"))


@query()
def heading_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles taken from whole pages, found again on them with the forward cursor; a test holds it against a walk over lines."""
    held = as_pages(spark, sf_dir)
    nowhere = spark.createDataFrame([], "source string, page int")
    found, _ = sections.heading_pages(toy_sections(spark, sf_dir).drop("pdf_page"), held.select("source", "page", "text"), nowhere)
    return found.select("source", "seq", "title", "pdf_page")


@query()
def toc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents pages of each source by the four searches on whole texts, parsed to entries; a test holds the merging against a fold."""
    loose = Settings(toc_ratio_untitled=0.0, toc_ratio_titled=0.0, min_toc_lines=1, fallback_lines=1, fallback_dot_lines=0, fallback_sentences=5)
    found, _ = toc.parse_toc(as_pages(spark, sf_dir), None, loose)
    return found


# --- ordered events ---


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


E_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)
SELECT event_id, first_value(v IGNORE NULLS) OVER ({E_ORDER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_value FROM e""")
def next_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return runs.next_value(e, ["user_id"], ["ts", "event_id"], "v", "next_value").select("event_id", "next_value")


@query(f"""
WITH e AS (SELECT event_id, user_id, ts, event_type = 'click' AS c, row_number() OVER ({E_ORDER}) AS n FROM events),
g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, c ORDER BY ts, event_id) AS run FROM e),
s AS (SELECT *, count(*) OVER (PARTITION BY user_id, c, run) AS size, min(n) OVER (PARTITION BY user_id, c, run) AS first FROM g),
k AS (SELECT event_id, user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY first) AS island FROM s WHERE c AND size >= 2)
SELECT event_id, island FROM k""")
def bullet_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.islands(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", "island", 2)
    return found.where("island is not null").select("event_id", "island")


@query(f"""
WITH e AS (SELECT event_id, user_id, ts, event_type, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 0 END AS ev FROM events),
s AS (SELECT *, last_value(ev IGNORE NULLS) OVER ({E_ORDER} ROWS UNBOUNDED PRECEDING) AS state, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER ({E_ORDER} ROWS UNBOUNDED PRECEDING) AS nth FROM e)
SELECT event_id, CAST(CASE WHEN state = 1 THEN nth END AS INTEGER) AS segment FROM s""")
def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.segments(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "error", "segment")
    return found.select("event_id", "segment")


@query(f"""
WITH e AS (SELECT *, row_number() OVER ({E_ORDER}) AS n FROM events),
a AS (SELECT event_id, min(CASE WHEN event_type = 'purchase' THEN n END) OVER w AS p, min(CASE WHEN event_type = 'error' THEN n END) OVER w AS x FROM e WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING))
SELECT event_id, p IS NOT NULL AND (x IS NULL OR p < x) AS leads FROM a""")
def lookahead8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.leads_before(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "error", 8, "leads")
    return found.select("event_id", "leads")


@query("""
SELECT p.event_id, max_by(s.event_id, (s.ts, s.event_id)) AS signup
FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND s.ts <= p.ts GROUP BY 1""")
def asof_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    left, right = (e.where(F.col("event_type") == kind).select("user_id", "ts", "event_id") for kind in ("purchase", "signup"))
    found = runs.as_of(left, right.withColumn("e", F.col("event_id")).drop("event_id"), ["user_id"], "ts", "e", "e", "signup")
    return found.select("event_id", "signup")


# --- sentences and packing ---

SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, len({SENTENCES}) AS n, md5(array_to_string({SENTENCES}, chr(10))) AS digest FROM documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t.sentences(F.col("text"))
    docs = table(spark, sf_dir, "documents").withColumn("s", s)
    return docs.select("doc_id", F.size("s").alias("n"), md5(F.array_join("s", "\n")).alias("digest"))


@query(r"""SELECT doc_id, len(regexp_extract_all(regexp_replace(regexp_replace(text, '\.{2,}', '', 'g'), '(?im)^\s*(\d+\.|[IVX]+\.|ПОГЛАВЉЕ\s+\d+\.)\s*', '', 'g'), '[.!?]\s+[А-ШЂЈЉЊЋЏA-Z]')) AS n FROM documents""")
def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.sentence_starts(F.col("text")).alias("n"))


@query(f"""
WITH RECURSIVE s AS (SELECT doc_id, {SENTENCES} AS parts FROM documents),
f(doc_id, parts, i, done, now, size, n) AS (
  SELECT doc_id, parts, 0, CAST([] AS VARCHAR[]), '', 0, 0 FROM s
  UNION ALL
  SELECT doc_id, parts, i + 1,
    CASE WHEN n > 0 AND size + len(x) + 1 > 700 THEN list_append(done, CASE WHEN size >= 200 THEN now ELSE now || ' ' || x END) ELSE done END,
    CASE WHEN n > 0 AND size + len(x) + 1 > 700 THEN CASE WHEN size >= 200 THEN x ELSE '' END WHEN n > 0 THEN now || ' ' || x ELSE x END,
    CAST(CASE WHEN n > 0 AND size + len(x) + 1 > 700 THEN CASE WHEN size >= 200 THEN len(x) ELSE 0 END ELSE size + len(x) + 1 END AS INTEGER),
    CASE WHEN n > 0 AND size + len(x) + 1 > 700 THEN CASE WHEN size >= 200 THEN 1 ELSE 0 END ELSE n + 1 END
  FROM (SELECT *, parts[i + 1] AS x FROM f WHERE i < len(parts))),
e AS (SELECT doc_id, CASE WHEN n > 0 THEN list_append(done, now) ELSE done END AS chunks FROM f WHERE i = len(parts))
SELECT doc_id, k - 1 AS chunk_index, len(chunks) AS chunk_total, length(chunks[k]) AS n_chars, md5(chunks[k]) AS digest FROM (SELECT doc_id, chunks, unnest(generate_series(1, len(chunks))) AS k FROM e)""")
def paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.paragraph_chunks(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "chunk_index", "chunk_total", F.length("text").alias("n_chars"), md5(F.col("text")).alias("digest"))


@query(f"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS items FROM documents),
p AS (SELECT doc_id, CASE WHEN length(text) <= 500 OR len(items) < 5 THEN [text] ELSE items END AS parts FROM l)
SELECT doc_id, k - 1 AS list_index, len(parts) AS list_total, md5(parts[k]) AS digest FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS k FROM p)""")
def list_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chunks.list_parts(F.col("text"), t.lines_of(F.col("text")))
    rows = table(spark, sf_dir, "documents").withColumn("parts", parts).select("doc_id", F.size("parts").alias("list_total"), F.posexplode("parts").alias("list_index", "item"))
    return rows.select("doc_id", "list_index", "list_total", md5(F.col("item")).alias("digest"))


# --- text keys, dictionaries, intents ---


@query(r"""
SELECT conv_id, turn,
  trim(substr(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_\s]', '', 'g'), '\s+', '_', 'g'), 1, 30), '_') AS slug,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[?!.,;:]+$', ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS query_key,
  translate(translate(text, 'abvgdezijklmnoprstufhc', 'абвгдезијклмнопрстуфхц'), 'аеојсркмтнивх', 'aeojcpkmtnubx') AS folded, text AS latin
FROM conversations""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    cyrillic = F.translate(x, "abvgdezijklmnoprstufhc", "абвгдезијклмнопрстуфхц")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.slug(x).alias("slug"), t.query_key(x).alias("query_key"), t.fold_homoglyphs(cyrillic).alias("folded"), t.to_latin(cyrillic).alias("latin"))


TOY_INTENTS = LanguagePack(intents=["dosage", "comparison", "causal", "precise"], intent_keywords={"dosage": ["the th", "dose"], "comparison": ["and "], "causal": ["er", "ou"]})


@query(r"""
WITH q AS (SELECT conv_id, turn, regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[?!.,;:]+$', ''), '\s+', ' ', 'g') AS f FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN contains(f, 'the th') OR contains(f, 'dose') THEN 'dosage' WHEN contains(f, 'and ') THEN 'comparison' WHEN contains(f, 'er') OR contains(f, 'ou') THEN 'causal' ELSE 'precise' END AS intent FROM q""")
def intent_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", retrieval.intent(F.col("text"), TOY_INTENTS).alias("intent"))


TOY_TERMS = LanguagePack(translations={"economy anodized": "economy", "large brushed steel": "brushed"}, primary_categories={"brand#11": "brand", "brand#12": "type"})


@query("""
WITH r AS (
  SELECT p_partkey, 'brand' AS category, p_brand AS term FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'type', p_brand FROM part),
n AS (SELECT p_partkey, category, trim(lower(term)) AS term FROM r),
k AS (SELECT * FROM n WHERE length(term) BETWEEN 2 AND 100 AND (term NOT IN ('brand#11', 'brand#12') OR (term = 'brand#11' AND category = 'brand') OR (term = 'brand#12' AND category = 'type')))
SELECT p_partkey, category, string_agg(DISTINCT term, '|' ORDER BY term) AS terms FROM k GROUP BY 1, 2""")
def category_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.explode(F.array(F.struct(F.lit("brand").alias("category"), F.col("p_brand").alias("term")), F.struct(F.lit("type").alias("category"), F.col("p_type").alias("term")), F.struct(F.lit("type").alias("category"), F.col("p_brand").alias("term")))).alias("r"))
    found = entities.normalised_terms(rows.select("p_partkey", "r.*"), TOY_TERMS)
    return found.groupBy("p_partkey", "category").agg(F.array_join(F.sort_array(F.collect_set("term")), "|").alias("terms"))



@query("""
WITH a AS (SELECT event_id, event_id % 4 AS kind, props FROM events)
SELECT event_id, CASE WHEN kind = 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM a""")
def llm_json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    answer = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here: "), F.col("props"), F.lit(" done."))).otherwise(F.concat(F.lit("broken {"), F.col("props")))
    return events(spark, sf_dir).select("event_id", F.try_variant_get(entities.repaired_json(answer), "$.k", "int").alias("k"))


# --- questions ---

TEMPLATES = [
    (1, "t1", "How is {brand} used with {type}?", "precise", ["brand", "type"]),
    (2, "t2", "What size has {size}?", "dosage", ["size"]),
    (3, "t3", "Is {missing} there?", "precise", ["missing"]),
    (4, "t4", "{x}", "precise", []),
]


@query("""
WITH p AS (SELECT p_partkey, p_brand, CAST(p_size AS VARCHAR) AS size, [p_type, p_name] AS types FROM part),
q AS (
  SELECT p_partkey, 't1' AS template_id, 'How is ' || p_brand || ' used with ' || types[k] || '?' AS query, 1 AS seq, k FROM (SELECT *, unnest([1, 2]) AS k FROM p)
  UNION ALL SELECT p_partkey, 't2', 'What size has ' || size || '?', 2, 1 FROM p WHERE length(size) >= 2)
SELECT p_partkey, template_id, regexp_replace(query, '\\s+', ' ', 'g') AS query, row_number() OVER (PARTITION BY p_partkey ORDER BY seq, k) AS question_no FROM q""".replace("\\\\", "\\"))
def question_instantiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    held = F.create_map(F.lit("brand"), F.array("p_brand"), F.lit("type"), F.array("p_type", "p_name"), F.lit("size"), F.array(F.col("p_size").cast("string")), F.lit("none"), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    records = part.select(F.col("p_partkey").cast("string").alias("chunk_id"), F.lit("part").alias("source"), F.lit(1).alias("pdf_page"), none.alias("section_path"), none.alias("section_ids"), held.alias("entities"))
    templates = spark.createDataFrame(TEMPLATES, "seq int, id string, template string, intent string, requires array<string>")
    found = questions.generated(records, templates)
    return found.select(F.col("source_chunk").cast("long").alias("p_partkey"), "template_id", "query", "question_no")


@query("""
SELECT a.p_size AS size, string_agg(b || '/' || c, ' ' ORDER BY i, j) AS combos
FROM (SELECT DISTINCT p_size FROM part) a, (SELECT unnest(['x', 'y', 'z']) AS b, unnest([1, 2, 3]) AS i), (SELECT unnest(['1', '2']) AS c, unnest([1, 2]) AS j)
WHERE (i - 1) * 2 + j <= 5 GROUP BY 1""")
def cartesian_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = lambda *x: F.array(*map(F.lit, x))
    combos = questions.combinations(strings("b", "c"), F.array(strings("x", "y", "z"), strings("1", "2")))
    text = F.array_join(F.transform(combos, lambda m: F.concat_ws("/", m["b"], m["c"])), " ")
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("size")).distinct().withColumn("combos", text)


@query(r"""
WITH k AS (SELECT role, conv_id, turn, text, length(text) % 7 AS size, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[?!.,;:]+$', ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS key FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY role, key ORDER BY size DESC, conv_id, turn) AS n, min((conv_id, turn)) OVER (PARTITION BY role, key) AS first FROM k WHERE key <> '')
SELECT role, conv_id, turn, first[1] AS first_conv, first[2] AS first_turn FROM r WHERE n = 1""")
def dedupe_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = questions.deduplicated(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], ["role"], F.length("text") % 7, "text")
    return found.select("role", "conv_id", "turn", F.col("_first.conv_id").alias("first_conv"), F.col("_first.turn").alias("first_turn"))


# --- statistics, sets ---


@query("""
SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'all' END AS dimension, coalesce(l_returnflag, l_linestatus) AS value, count(*) AS n
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chunk_counts(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, min(p_partkey), p_brand LIMIT 10")
def top_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.top_counts(table(spark, sf_dir, "part"), "p_brand", 10, "p_partkey")


@query("""
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, f, o_orderpriority) AS k FROM c) WHERE k <= 3""")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.top_counts(table(spark, sf_dir, "orders"), "o_orderpriority", 3, "o_orderkey", ["o_orderstatus"]).select("o_orderstatus", "o_orderpriority", "n")


@query("""
WITH x AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))) AS ids FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, array_to_string(list_filter(ids, lambda i: i <> CAST(l_partkey AS VARCHAR)), ',') AS related FROM lineitem JOIN x USING (l_orderkey)""")
def related_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_orderkey").cast("string")).alias("section_ids"), F.lit(False).alias("is_summary"), F.col("l_partkey").cast("string").alias("recommendation_id"), F.lit(None).cast("string").alias("table_id"), F.lit(None).cast("string").alias("list_id"))
    return chunks.related(rows).select("l_orderkey", "l_linenumber", F.array_join("related_recommendations", ",").alias("related"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")



@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def toc_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select("doc_id", "source")


# --- vectors ---

SCORES = "s AS (SELECT q.vec_id AS qid, i.vec_id AS id, i.label AS label, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 12) AS score FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)"


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, index): every vector whose id is divisible by 20 against all."""
    v = table(spark, sf_dir, "embeddings")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding", F.col("label").cast("string").alias("intent")), v.select(F.col("vec_id").alias("id"), "embedding", "label")


@query("SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x / n)), 6) AS squares, round(e[1] / sqrt(n), 6) AS first FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS n FROM embeddings)")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").withColumn("n", retrieval.normalised(F.col("embedding")))
    return v.select("vec_id", F.round(retrieval.inner_product(F.col("n"), F.col("n")), 6).alias("squares"), F.round(F.element_at("n", 1), 6).alias("first"))


@query(f"WITH {SCORES} SELECT qid, id, rank, round(score, 6) AS score FROM r WHERE rank <= 25")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, index = vectors(spark, sf_dir)
    return retrieval.top_k(asked, index, 25, exclude_self=True).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {SCORES} SELECT qid, id, rank, round(score, 6) AS score, 'true' AS bounded FROM r WHERE rank <= 25")
def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from an index in many cells; no query meets more than the whole index."""
    asked, index = vectors(spark, sf_dir)
    held = retrieval.cells.dealt(index, 24)
    found = retrieval.cells.search(asked, held, 25, exclude_self=True)
    met = retrieval.cells.share_read(asked, held, 25, found, exclude_self=True)
    return found.join(met.select("qid", F.col("share").between(0, 1).cast("string").alias("bounded")), "qid").select("qid", "id", "rank", F.round("score", 6).alias("score"), "bounded")


@query(f"WITH {SCORES} SELECT qid, id, rank, label FROM r WHERE rank <= 15 AND score >= 0.3 AND label % 2 = 0")
def topk_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, index = vectors(spark, sf_dir)
    found = retrieval.top_k(asked, index, 15, exclude_self=True).where("score >= 0.3")
    return found.join(index.select("id", "label"), "id").where("label % 2 = 0").select("qid", "id", "rank", "label")


@query(f"""
WITH {SCORES},
h AS (SELECT *, row_number() OVER (PARTITION BY qid, id // 3 ORDER BY rank) AS n FROM r WHERE rank <= 25 AND score >= 0.4),
a AS (SELECT qid, 'c' || (id // 3) AS chunk_id, score, rank, 'question' AS level FROM h WHERE n = 1),
b AS (SELECT qid, 'c' || id AS chunk_id, score, rank, 'passage' AS level FROM r WHERE rank <= 15 AND score >= 0.3 AND qid NOT IN (SELECT qid FROM a)),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT qid, chunk_id, level, rank, round(score, 6) AS match_score FROM (SELECT qid, chunk_id, level, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM u) WHERE rank <= 5""")
def two_level_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored questions point to every third chunk; passages are the chunks themselves."""
    asked, index = vectors(spark, sf_dir)
    path = F.array(F.col("label").cast("string"))
    stored = index.select("id", "embedding", path.alias("section_path"), F.concat(F.lit("c"), F.floor(F.col("id") / 3).cast("string")).alias("source_chunk"))
    known = index.select("id", "embedding", path.alias("section_path"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"))
    found = retrieval.retrieve(asked, stored, known, Settings(question_score=0.4, passage_score=0.3), exclude_self=True)
    return found.select("qid", "chunk_id", "level", "rank", F.round("match_score", 6).alias("match_score"))


def queries() -> dict[str, Query]:
    from . import made_queries  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import made_queries  # noqa: F401

    return dict(SQL)
