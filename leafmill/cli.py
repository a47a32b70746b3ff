"""The stages and the query as commands: ``python -m leafmill STAGE ...``.

Tables are Parquet folders; every stage reads the ones that earlier stages wrote.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunks, entities, pages, questions, sections, stats, structure, toc
from .packs import LanguagePack, guideline_pack
from .plans import build
from .sources import models, readers, writers

#: Our own questions for a first look at an index.
SAMPLES = [
    "Čime se leči pogoršanje bronhitisa?",
    "Koja je dnevna doza prednizona?",
    "Može li se emfizem izlečiti?",
    "Koji su prvi simptomi upale pluća?",
    "Kada kiseonik ne treba davati?",
    "Kako se dijagnostikuje astma kod dece?",
    "Šta je spirometrija?",
    "Kako se sprečava pogoršanje bolesti?",
    "Zašto dolazi do gušenja?",
    "Koji su faktori rizika za emfizem?",
]


def _encoder(name: str | None):
    return (lambda: models.SentenceEncoder(name)) if name else models.HashingEncoder


def _show(df: DataFrame, rows: int = 1000) -> None:
    for r in df.limit(rows).collect():
        print("  " + "  ".join(f"{k}={v}" for k, v in r.asDict().items()))


def print_result(rows: list, query: str, intent: str, width: int = 200) -> None:
    """One query's answer, best passage first."""
    level = rows[0]["level"] if rows else "none"
    print(f"\nquery:  {query}\nintent: {intent}\nlevel:  {level}\npassages: {len(rows)}")
    for r in sorted(rows, key=lambda r: r["rank"]):
        print(f"\n{r['rank']}. {r['chunk_id']}  ({r['source']}, page {r['pdf_page']}, {r['chunk_type']}, score {r['match_score']:.3f})")
        print(f"   {' > '.join(r['section_path'] or [])}")
        if r["matched_query"]:
            print(f"   asked as: {r['matched_query']}  [{r['template_id']}]")
        print(f"   {stats.cut(r['text'] or '', width)}")


def ask(spark: SparkSession, index: str, asked: list[str], encoder: str | None, pack: LanguagePack) -> None:
    """Answer queries from ``index/question_index`` and ``index/passage_index``."""
    stored, _ = readers.read_index(spark, f"{index}/question_index")
    passages, _ = readers.read_index(spark, f"{index}/passage_index")
    stored, passages = stored.withColumnRenamed("embedding_id", "id"), passages.withColumnRenamed("embedding_id", "id")
    frame = spark.createDataFrame(list(enumerate(asked)), "qid bigint, query string")
    intents = {r.qid: r.intent for r in frame.select("qid", build.retrieval.intent(F.col("query"), pack).alias("intent")).collect()}
    found: dict[int, list] = {k: [] for k in range(len(asked))}
    for r in build.answer(frame, stored, passages, _encoder(encoder), pack).collect():
        found[r["qid"]].append(r)
    for k, query in enumerate(asked):
        print_result(found[k], query, intents[k])


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    read = lambda name: spark.read.parquet(f"{args.work}/{name}")

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{args.work}/{name}")
        return read(name)

    pack = LanguagePack.from_json(args.pack) if args.pack else guideline_pack()
    stage = args.stage
    if stage == "extract":
        if missing := readers.missing_libraries():
            sys.exit(f"not installed: {', '.join(missing)}")
        rows = write(readers.pdf_rows(spark, args.input), "pdf_rows")
        _show(readers.pdf_report(rows))
        _show(pages.page_stats(write(pages.clean_pages(rows.where("failure is null").select("source", "page", "text")), "pages")))
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(args.input).select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
        write(pages.explicit_toc_pages(pages.latest_files(files).drop("source"), pack), "explicit")
    elif stage == "toc":
        found, located = toc.parse_toc(read("pages"), read("explicit").where("toc_pages is not null"), pack=pack)
        located = write(located, "located")
        _show(toc.toc_documents(read("pages"), located, write(found, "entries")))
    elif stage == "map":
        mapped, report = sections.heading_pages(read("entries"), read("pages"), read("located"))
        write(mapped, "sections")
        _show(report)
    elif stage == "structure":
        found, recs = structure.parse_structure(read("pages"), pack=pack)
        write(structure.hierarchy(found), "structure")
        write(recs, "recommendations")
        _show(read("structure").select("source", "n_sections"))
    elif stage == "chunk":
        _show(stats.chunk_counts(write(chunks.document_chunks(read("sections"), read("pages"), pack), "chunks"), "source", "chunk_type"))
    elif stage == "entities":
        client = models.ChatClient(args.url, args.model, pack.entity_types)
        if not client.reachable():
            sys.exit(f"no answer from {args.url}")
        log, lost = f"{args.work}/extraction", F.col("status") == models.FAILED
        told = writers.run_resumed(read("chunks"), lambda rows: models.extraction(rows, lambda: client, pack), log, again=lost)
        _show(told.groupBy("status").count())
        write(models.records(told), "entities")
        if (left := writers.failed(spark, log)) is not None and left.take(1):
            print("failed, asked again by the next run:")
            _show(left.groupBy("failure").count())
    elif stage == "normalise":
        _show(entities.entity_stats(read("entities"), write(entities.normalised_entities(read("entities"), pack), "normalised")))
    elif stage == "questions":
        raw = write(questions.generated(read("normalised"), readers.read_templates(spark, args.input)), "raw_questions")
        kept = write(questions.deduplicated(raw, ["source_chunk", "question_no"], ["source"], F.size("entities")).drop("_first"), "questions")
        _show(questions.instance_stats(read("normalised"), raw, kept))
        _show(questions.question_report(kept))
    elif stage == "embed":
        rows = models.embedded(read("chunks"), _encoder(args.model))
        writers.write_index(rows, f"{args.work}/passage_index", ["source", "seq", "kind_rank", "item_seq"], args.model or "hashed words", models.PASSAGE_PREFIX)
    elif stage == "embed-questions":
        rows = models.embedded(read("questions"), _encoder(args.model), "query", models.QUERY_PREFIX)
        writers.write_index(rows, f"{args.work}/question_index", ["source", "source_chunk", "question_no"], args.model or "hashed words", models.QUERY_PREFIX)
    elif stage == "retrieve":
        if args.query or args.test:
            ask(spark, args.work, [args.query] if args.query else SAMPLES, args.model, pack)
            return
        while (line := sys.stdin.readline()) and line.strip().lower() not in ("exit", "quit"):
            if line.strip():
                ask(spark, args.work, [line.strip()], args.model, pack)


STAGES = ["extract", "toc", "map", "structure", "chunk", "entities", "normalise", "questions", "embed", "embed-questions", "retrieve"]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="leafmill", description=__doc__)
    parser.add_argument("stage", choices=STAGES)
    parser.add_argument("work", help="the folder of the stages' tables")
    parser.add_argument("--input", help="a folder of PDF files (extract) or a file of templates (questions)")
    parser.add_argument("--pack", help="a language pack as JSON")
    parser.add_argument("--model", help="a sentence encoder's or an extractor's name")
    parser.add_argument("--url", default="http://localhost:1234/v1", help="the extractor's service")
    parser.add_argument("--query")
    parser.add_argument("--test", action="store_true", help="ask the sample questions")
    args = parser.parse_args(argv)
    run(SparkSession.builder.appName("leafmill").getOrCreate(), args)
