"""Questions from templates and entities, one of each kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..packs import Settings
from ..shared import written
from .runs import numbered


def placeholders(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(r"(?U)\{(\w+)\}"), F.lit(1))


def combinations(names: Column, values: Column, most: int = 5) -> Column:
    """The first ``most`` maps of a Cartesian product, the last name's values fastest.

    ``values`` is an array of arrays beside ``names``. Cutting each level to
    ``most`` changes nothing, as the order is lexicographic.
    """
    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("n"), v.alias("v")))
    entry = "struct<k:string,v:string>"
    start = F.array(F.array().cast(f"array<{entry}>"))

    def step(held: Column, x: Column) -> Column:
        grown = F.flatten(F.transform(held, lambda c: F.transform(x["v"], lambda v: F.array_append(c, F.struct(x["n"].alias("k"), v.alias("v"))))))
        return F.slice(grown, 1, most)

    return F.transform(F.aggregate(pairs, start, step), F.map_from_entries)


def filled(template: Column, values: Column) -> Column:
    """The template with each placeholder's value, single spaces.

    The template is cut at its placeholders once, so braces in a value stay.
    """
    pattern = r"(?U)\{\w+\}"
    names = F.concat(F.transform(F.regexp_extract_all(template, F.lit(pattern), F.lit(0)), lambda x: F.substr(x, F.lit(2), F.length(x) - 2)), F.array(F.lit("")))
    value = lambda name: F.coalesce(F.try_element_at(values, name), F.when(name == "", F.lit("")).otherwise(F.concat(F.lit("{"), name, F.lit("}"))))
    pieces = F.zip_with(F.split(template, pattern, -1), names, lambda text, name: F.concat(text, value(name)))
    return t.strip(t.single_spaces(F.array_join(pieces, "")))


def met_templates(chunks: DataFrame, forms: DataFrame, least: int) -> DataFrame:
    """Chunks beside the templates whose rarest required type they have.

    Only the types of which a chunk has a term of ``least`` characters count. A
    template is looked up by the one of its types that fewest chunks have, so a
    type that most chunks have brings them to no template that asks for more. The
    templates are handed to the chunks whatever Spark takes their sizes for.
    """
    good = F.map_keys(F.map_filter("entities", lambda _, terms: F.exists(terms, lambda v: F.length(v) >= least)))
    typed = chunks.withColumn("_types", good)
    often = typed.select(F.explode("_types").alias("_type")).groupBy("_type").agg(F.count("*").alias("_often"))
    asked = forms.select("_seq", "template_id", F.posexplode("requires").alias("_k", "_type")).join(often, "_type", "left")
    rarest = asked.groupBy("_seq", "template_id").agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "_k", "_type"))["_type"].alias("_type"))
    keyed = forms.join(rarest, ["_seq", "template_id"])
    return typed.withColumn("_type", F.explode("_types")).join(F.broadcast(keyed), "_type")


def generated(records: DataFrame, templates: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Entity records x templates whose required types they have -> questions.

    Templates are a small table in a given order (``seq``); pairs are found by
    each one's rarest required type, and then held against all of them.
    """
    least = settings.term_min
    some = F.size(F.filter(F.map_values("entities"), lambda v: F.size(v) > 0)) >= settings.min_entity_types
    forms = templates.withColumn("_names", F.array_distinct(placeholders(F.col("template")))).where("size(requires) > 0 and size(_names) > 0")
    forms = forms.select(F.col("seq").alias("_seq"), F.col("id").alias("template_id"), "template", "intent", "requires", "_names")
    # dealt out as the numbering below asks for, before questions make many rows of them
    met = met_templates(records.where(some).repartition("source", "chunk_id"), forms, least).where(F.forall("requires", lambda r: F.array_contains("_types", r)))
    kept = lambda kind: F.slice(F.filter(F.coalesce(F.try_element_at("entities", kind), F.array().cast("array<string>")), lambda v: F.length(v) >= least), 1, settings.values_per_placeholder)
    met = met.withColumn("_values", F.transform("_names", kept)).where(F.forall("_values", lambda v: F.size(v) > 0))
    rows = met.select("*", F.posexplode(combinations(F.col("_names"), F.col("_values"), settings.combinations)).alias("_k", "_combo"))
    rows = rows.withColumn("query", filled(F.col("template"), F.col("_combo"))).where(F.length("query") >= settings.min_question_chars)
    w = Window.partitionBy("source", "chunk_id").orderBy("_seq", "_k")
    rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= settings.questions_per_chunk)
    return rows.select("query", "template_id", "intent", F.col("_combo").alias("entities"), "source", "pdf_page", "section_path", "section_ids", F.col("chunk_id").alias("source_chunk"), F.col("_n").alias("question_no"))


def deduplicated(questions: DataFrame, order: list[str], group: list[str], size: Column, query: str = "query") -> DataFrame:
    """Of equal query keys the row of most entities (ties: the first), at the first one's place.

    ``_first`` tells the place: the order columns of the key's first row.
    """
    keyed = questions.withColumn("_key", t.query_key(F.col(query))).where("_key <> ''").withColumn("_size", size)
    # aggregates join equal keys before the shuffle; a window would send all rows of a key to one task
    place = F.struct(F.isnull("_size"), -F.col("_size"), *order)
    ranked = keyed.groupBy(*(F.col(c).alias(f"_g{k}") for k, c in enumerate(group)), "_key").agg(F.min_by(F.struct(*questions.columns), place).alias("_row"), F.min(F.struct(*order)).alias("_first"))
    return ranked.select("_row.*", "_first")


def top_counts(rows: DataFrame, by: str, n: int, order: str | None = None, group: list[str] | None = None) -> DataFrame:
    """The ``n`` most frequent values (of each group), ties by their first row."""
    group = group or []
    counted = rows.groupBy(*group, by).agg(F.count("*").alias("n"), (F.min(order) if order else F.min(by)).alias("_first"))
    if not group:
        return counted.orderBy(F.desc("n"), "_first", by).limit(n).drop("_first")
    w = Window.partitionBy(*group).orderBy(F.desc("n"), "_first", by)
    return counted.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_first", "_k")


def instance_stats(chunks: DataFrame, raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Per source: all its chunks, questions made, kept and removed, kept ones by template."""
    by = kept.groupBy("source", "template_id").agg(F.count("*").alias("n"))
    by = by.groupBy("source").agg(F.sum("n").alias("n_final"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("template_id", "n")))).alias("by_template"))
    out = chunks.groupBy("source").agg(F.count("*").alias("n_chunks")).join(raw.groupBy("source").agg(F.count("*").alias("n_raw")), "source", "left").join(by, "source", "left")
    none = F.create_map().cast("map<string,bigint>")
    out = out.select("source", "n_chunks", F.coalesce("n_raw", F.lit(0)).alias("n_raw"), F.coalesce("n_final", F.lit(0)).alias("n_final"), F.coalesce("by_template", none).alias("by_template"))
    return out.withColumn("n_removed", F.col("n_raw") - F.col("n_final"))


def question_report(questions: DataFrame, n: int = 10) -> DataFrame:
    """``(dimension, value, n, rank)``: all sources by name, the ``n`` most frequent intents and templates."""
    by = ("source", "intent", "template_id")
    # the questions are read once; what they are counted by is few rows
    held, _ = written(questions.groupBy(*(F.coalesce(c, F.lit("?")).alias(c) for c in by)).agg(F.count("*").alias("n")), "question-counts")
    counted = {c: held.groupBy(F.col(c).alias("value")).agg(F.sum("n").alias("n")) for c in by}
    parts = [numbered(counted["source"], ["value"], "rank")]
    for c in ("intent", "template_id"):
        # ranks of at most n rows
        most = counted[c].orderBy(F.desc("n"), "value").limit(n)
        parts.append(most.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value"))))
    told = [part.select(F.lit(c).alias("dimension"), "value", "n", "rank") for c, part in zip(counted, parts)]
    return told[0].unionByName(told[1]).unionByName(told[2])
