"""The jobs as queries: each runs twice into a new folder, and its output is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.queries import SENTENCES, STRIP
from leafmill.shared import new_path

from . import question_bank, refresh_chunks

#: Keywords that the test tables' invented prose holds.
INTENTS = {"dosage": ["the th", "dose"], "comparison": ["and ", "und ", "et "], "causal": ["er", "ou"], "precise": []}


def job1_refresh_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chunks; the second run finds nothing new."""
    output, checkpoint = new_path(spark, "job1"), new_path(spark, "job1-checkpoint")
    for _ in range(2):
        refresh_chunks.refresh(spark, f"{sf_dir}/documents.parquet", output, checkpoint)
    found = refresh_chunks.current_chunks(spark, output)
    return found.select("doc_id", "lang", "source", "chunk_id", "chunk_index", "chunk_total", "n_chars", "n_sentences", F.md5(F.col("text").cast("binary")).alias("digest"))


def job2_question_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank, with each question's rank among its intent's most asked and its intent's share."""
    output, config = new_path(spark, "job2"), question_bank.Config(intents=INTENTS)
    for _ in range(2):
        question_bank.build(spark, f"{sf_dir}/conversations.parquet", output, config)
    bank, report, top = (question_bank.read_back(spark, output, config.snapshot, name) for name in ("bank", "report", "top"))
    both = bank.join(top.drop("n_asked"), ["intent", "query_key"], "left").join(report.select("intent", "n_questions", "n_answered", "thousandths"), "intent")
    md5 = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return both.select("intent", md5("query_key"), md5("query"), md5("answer"), "conv_id", "turn", "first_conv", "first_turn", "n_asked", "n_conversations", "rank", "n_questions", "n_answered", "thousandths")


def _packed_sql() -> str:
    """The chunks of every cleaned document, by a recursion over its sentences."""
    clean = STRIP.format(r"regexp_replace(coalesce(text, ''), '[ \t\r\f\v]+(\n|$)', '\1', 'g')")
    return rf"""
WITH RECURSIVE c AS (SELECT doc_id, lang, source, {clean} AS text FROM documents),
s AS (SELECT doc_id, {SENTENCES} AS parts FROM c WHERE length(text) >= 100),
f(doc_id, parts, i, done, sizes, now, size, n, held) AS (
  SELECT doc_id, parts, 0, CAST([] AS VARCHAR[]), CAST([] AS INTEGER[]), '', 0, 0, 0 FROM s
  UNION ALL
  SELECT doc_id, parts, i + 1,
    CASE WHEN closes AND size >= 200 THEN list_append(done, now) WHEN closes THEN list_append(done, now || ' ' || x) ELSE done END,
    CASE WHEN closes AND size >= 200 THEN list_append(sizes, held) WHEN closes THEN list_append(sizes, held + 1) ELSE sizes END,
    CASE WHEN closes AND size >= 200 THEN x WHEN closes THEN '' WHEN n > 0 THEN now || ' ' || x ELSE x END,
    CAST(CASE WHEN closes AND size >= 200 THEN len(x) WHEN closes THEN 0 ELSE size + len(x) + 1 END AS INTEGER),
    CASE WHEN closes AND size >= 200 THEN 1 WHEN closes THEN 0 ELSE n + 1 END,
    CASE WHEN closes AND size >= 200 THEN 1 WHEN closes THEN 0 ELSE held + 1 END
  FROM (SELECT *, n > 0 AND size + len(x) + 1 > 700 AS closes FROM (SELECT *, parts[i + 1] AS x FROM f WHERE i < len(parts)))),
e AS (SELECT doc_id, CASE WHEN n > 0 THEN list_append(done, now) ELSE done END AS chunks, CASE WHEN n > 0 THEN list_append(sizes, held) ELSE sizes END AS sizes FROM f WHERE i = len(parts)),
k AS (SELECT *, unnest(generate_series(1, len(chunks))) AS k FROM e)
SELECT doc_id, coalesce(nullif({STRIP.format('lang')}, ''), 'und') AS lang, source, source || '::' || doc_id || '::p::c' || (k - 1) AS chunk_id, CAST(k - 1 AS INTEGER) AS chunk_index, CAST(len(chunks) AS INTEGER) AS chunk_total,
  length(chunks[k]) AS n_chars, sizes[k] AS n_sentences, md5(chunks[k]) AS digest
FROM k JOIN documents USING (doc_id)"""


def _bank_sql() -> str:
    form = r"regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[?!.,;:]+$', ''), '\s+', ' ', 'g')"
    told = lambda words: " OR ".join(f"contains(form, '{w}')" for w in words)
    named = list(INTENTS)
    intent = "CASE " + " ".join(f"WHEN {told(INTENTS[name])} THEN '{name}'" for name in named[:-1]) + f" ELSE '{named[-1]}' END"
    return rf"""
WITH u AS (SELECT conv_id, turn, text, {form} AS form FROM conversations WHERE role = 'user'),
q AS (SELECT conv_id, turn, text, regexp_replace(form, '^\s+|\s+$', '', 'g') AS query_key, {intent} AS intent FROM u),
a AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant'),
r AS (SELECT *, row_number() OVER (PARTITION BY intent, query_key ORDER BY coalesce(length(answer), -1) DESC, conv_id, turn) AS n,
  min((conv_id, turn)) OVER (PARTITION BY intent, query_key) AS first, count(*) OVER (PARTITION BY intent, query_key) AS n_asked
  FROM q LEFT JOIN a USING (conv_id, turn) WHERE query_key <> ''),
c AS (SELECT intent, query_key, count(DISTINCT conv_id) AS n_conversations FROM q GROUP BY 1, 2),
b AS (SELECT r.*, n_conversations, row_number() OVER (PARTITION BY intent ORDER BY n_asked DESC, query_key) AS place FROM r JOIN c USING (intent, query_key) WHERE n = 1),
s AS (SELECT intent, count(*) AS n_questions, count(answer) AS n_answered, sum(n_asked) AS n FROM b GROUP BY 1)
SELECT intent, md5(query_key) AS query_key, md5(text) AS query, md5(answer) AS answer, conv_id, turn, first[1] AS first_conv, first[2] AS first_turn, n_asked, n_conversations,
  CAST(CASE WHEN place <= 10 THEN place END AS INTEGER) AS rank, n_questions, n_answered, CAST(s.n * 1000 // (SELECT sum(n) FROM s) AS BIGINT) AS thousandths
FROM b JOIN s USING (intent)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_refresh_chunks": job1_refresh_chunks, "job2_question_bank": job2_question_bank}


def oracle_sql() -> dict[str, str]:
    return {"job1_refresh_chunks": _packed_sql(), "job2_question_bank": _bank_sql()}
