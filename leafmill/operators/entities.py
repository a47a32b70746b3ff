"""Entities: repairing an extractor's JSON, normalising terms, counting them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..packs import LanguagePack, Settings


def repaired_json(answer: Column) -> Column:
    """The first ``{`` to the last ``}`` of an answer, fences taken off, as VARIANT or null."""
    bare = t.strip(answer)
    bare = F.regexp_replace(bare, r"(?dU)\A```(json)?\s*", "")
    bare = F.regexp_replace(bare, r"(?dU)\s*```\z", "")
    return F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))


def valid_entities(parsed: Column, types: list[str]) -> Column:
    """``map<type, terms>``: for every type its non-blank strings, lower-cased, distinct, sorted."""

    def terms(kind: str) -> Column:
        listed = F.try_variant_get(parsed, f"$.{kind}", "array<variant>")
        strings = F.filter(listed, lambda x: F.schema_of_variant(x) == "STRING")
        clean = F.transform(strings, lambda x: F.lower(t.strip(F.try_variant_get(x, "$", "string"))))
        return F.coalesce(F.array_sort(F.array_distinct(F.filter(clean, lambda x: x != ""))), F.array().cast("array<string>"))

    return F.create_map(*(x for kind in types for x in (F.lit(kind), terms(kind))))


def has_entity(entities: Column) -> Column:
    return F.exists(F.map_values(entities), lambda v: F.size(v) > 0)


def _least_shared(size: int, settings: Settings) -> int:
    """How many letter pairs a term of ``size`` letters must share with any known term that it is like.

    A ratio above the threshold asks for M equal letters of both terms' total; all
    others are put in or left out, so the equal ones stand in at most as many
    stretches and one more, and each stretch of n letters has n - 1 pairs.
    """
    needs = []
    for other in range(max(1, size - settings.term_gap), size + settings.term_gap + 1):
        total = size + other
        equal = max(1, math.ceil(settings.term_fuzzy * total / 2 - 1e-9))
        if equal <= min(size, other):
            needs.append(equal - (total - 2 * equal) - 1)
    return min(needs, default=size)


def _letter_pairs(terms: DataFrame, name: str) -> DataFrame:
    """``(name, size, pair)``; the second of two equal pairs is numbered as another one."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(F.col(name), i, F.lit(2)))
    numbered = F.transform("_pairs", lambda p, i: F.concat(p, F.size(F.filter(F.slice("_pairs", F.lit(1), i + 1), lambda x: x == p)).cast("string")))
    return terms.withColumn("_pairs", pairs).select(name, F.length(name).alias("size"), F.explode(numbered).alias("pair"))


def _rare_pairs(pairs: DataFrame, name: str, often: DataFrame, most: int, settings: Settings) -> DataFrame:
    """So many of a term's pairs, the rarest first, that like terms have one in common.

    A term so short, or a threshold so low, that no pair need be shared also has
    the empty pair.
    """
    ranked = pairs.join(often, "pair", "left").withColumn("_k", F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("_often", F.lit(0)), "pair")))
    shared = F.array(*[F.lit(_least_shared(n, settings)) for n in range(1, most + 1)])
    ranked = ranked.withColumn("_shared", F.element_at(shared, F.least("size", F.lit(most))))
    none = ranked.where((F.col("_shared") <= 0) & (F.col("_k") == 1)).withColumn("pair", F.lit(""))
    return ranked.where(F.col("_k") <= F.col("size") - F.greatest("_shared", F.lit(1))).unionByName(none).select(name, "size", "pair")


def like_terms(terms: DataFrame, known: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(term)``, ``(known)``, both distinct -> ``(term, known, ratio)`` of the pairs above the threshold.

    Both sides are looked up by their rarest letter pairs, as an equality join;
    what meets is held against the bound by letters and then compared.
    """
    most = known.agg(F.coalesce(F.max(F.length("known")), F.lit(0))).first()[0] + settings.term_gap
    pairs = _letter_pairs(known, "known")
    often = pairs.groupBy("pair").agg(F.count("*").alias("_often"))
    near = terms.where(F.length("term").between(1, most))
    left = _rare_pairs(_letter_pairs(near, "term"), "term", often, most, settings)
    right = _rare_pairs(pairs, "known", often, most, settings).where("pair <> ''").withColumnRenamed("size", "_size")
    both = left.join(right, "pair").select("term", "known", "size", "_size")
    # where nothing need be shared, terms meet by their lengths
    sizes = F.explode(F.sequence(F.greatest(F.col("size") - settings.term_gap, F.lit(1)), F.col("size") + settings.term_gap))
    wild = left.where("pair = ''").select("term", "size", sizes.alias("_size")).join(known.withColumn("_size", F.length("known")), "_size").select("term", "known", "size", "_size")
    total, least = F.col("size") + F.col("_size"), F.least("size", "_size")
    met = both.unionByName(wild).where((F.abs(F.col("size") - F.col("_size")) <= settings.term_gap) & (2 * least > settings.term_fuzzy * total)).select("term", "known").distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for term, other in zip(*(c.to_pylist() for c in batch.columns)):
                matcher = SequenceMatcher(None, term, other)
                if matcher.quick_ratio() > settings.term_fuzzy and (ratio := matcher.ratio()) > settings.term_fuzzy:
                    rows.append((term, other, ratio))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["term", "known", "ratio"])

    return met.mapInArrow(compare, "term string, known string, ratio double")


def fuzzy_terms(terms: DataFrame, pack: LanguagePack, settings: Settings = Settings()) -> DataFrame:
    """``(term)`` distinct -> ``(term, corrected)``: the most similar known term.

    Known terms, and terms under the least length, stay as they are. The most
    similar wins, of equals the first by name.
    """
    spark, own = terms.sparkSession, terms.select("term").distinct()
    if not pack.known_terms:
        return own.withColumn("corrected", F.col("term"))
    known = spark.createDataFrame([(x,) for x in sorted(set(pack.known_terms)) if x], "known string")
    unknown = own.where(F.length("term") >= settings.term_fuzzy_min).join(known.withColumnRenamed("known", "term"), "term", "left_anti")
    best = like_terms(unknown, known, settings).groupBy("term").agg(F.min(F.struct((-F.col("ratio")).alias("_worse"), "known"))["known"].alias("_best"))
    return own.join(best, "term", "left").select("term", F.coalesce("_best", "term").alias("corrected"))


def normalised_terms(rows: DataFrame, pack: LanguagePack, settings: Settings = Settings()) -> DataFrame:
    """``rows(..., category, term)`` -> the same with normalised terms, invalid ones left out.

    Latin script, dictionary translation, single spaces, spelling correction on
    distinct terms, length limits, then each term's primary category: elsewhere
    the term is dropped, not moved.
    """
    spark = rows.sparkSession
    latin = F.lower(t.strip(t.to_latin(t.strip(F.col("term")))))
    looked = rows.where(t.strip(F.col("term")) != "").withColumn("term", latin)
    translations = spark.createDataFrame(list(pack.translations.items()), "term string, _to string")
    looked = looked.join(translations, "term", "left").withColumn("term", t.single_spaces(F.lower(t.strip(F.coalesce("_to", "term"))))).drop("_to")
    looked = looked.join(fuzzy_terms(looked.select("term"), pack, settings), "term").withColumn("term", F.col("corrected")).drop("corrected")
    sized = looked.where(F.length("term").between(settings.term_min, settings.term_max))
    primary = spark.createDataFrame(list(pack.primary_categories.items()), "term string, _primary string")
    return sized.join(primary, "term", "left").where("_primary is null or _primary = category").drop("_primary")


def normalised_entities(records: DataFrame, pack: LanguagePack, settings: Settings = Settings()) -> DataFrame:
    """Entity records with normalised maps; records left without terms stay, empty."""
    keyed = records.withColumn("_row", F.monotonically_increasing_id()) if "chunk_id" not in records.columns else records
    key = "chunk_id" if "chunk_id" in records.columns else "_row"
    long = keyed.select(key, F.explode("entities").alias("category", "_terms")).select(key, "category", F.explode("_terms").alias("term"))
    found = normalised_terms(long, pack, settings)
    by = found.groupBy(key, "category").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    maps = by.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "terms")))).alias("_map"))
    empty = F.create_map().cast("map<string,array<string>>")
    return keyed.join(maps, key, "left").withColumn("entities", F.coalesce("_map", empty)).select(*records.columns)


def entity_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: chunks, those with entities and terms before and after, overlong terms, reduction in per cent."""

    def told(df: DataFrame, suffix: str) -> DataFrame:
        sizes = F.aggregate(F.map_values("entities"), F.lit(0), lambda held, v: held + F.size(v))
        long = F.aggregate(F.map_values("entities"), F.lit(0), lambda held, v: held + F.size(F.filter(v, lambda x: F.length(x) > 100)))
        return df.agg(F.count("*").alias(f"chunks{suffix}"), F.count_if(sizes > 0).alias(f"with_entities{suffix}"), F.coalesce(F.sum(sizes), F.lit(0)).alias(f"terms{suffix}"), F.coalesce(F.sum(long), F.lit(0)).alias(f"too_long{suffix}"))

    both = told(before, "_before").join(told(after, "_after"))
    return both.withColumn("reduction", F.when(F.col("terms_before") > 0, (1 - F.col("terms_after") / F.col("terms_before")) * 100).otherwise(F.lit(0.0)))
