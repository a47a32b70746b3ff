"""Which sources of a language speak unlike each other, and by which terms.

Every (language, source) group gives each term of its language a share of the
group's words, smoothed and in whole billionths; two shares p and q diverge by
``(p - q)**2 // (p + q)``. The audit tells, for every ordered pair of sources of a
language, the sum of that over all terms (part ``pair``), and for every group the
terms that it uses more than its language does (part ``term``).

Terms that occur equally often in every source have the same shares everywhere.
So terms are grouped by their sparse vector of (source, count), each distinct
vector is evaluated once for every pair of sources, and the result counts as
often as the vector has terms. A pair of sources that both lack a term has the
same divergence for every such term: it is a constant of the pair, and vectors
add only what departs from it. Sources are dealt out in blocks of ``BLOCK``, so
that a task holds ``BLOCK`` rows of one language's table of pairs, and the
vectors of a block are dealt out by salt. The original terms are ranked at the
end; of one vector's terms only the first ``top`` by name can be.

All numbers are exact: shares in 38 digits or by long division in 64 bits
(languages of up to 9e15 words), the rest in 64 bits.

Defined cases: a null text, language or source is the empty string; a group
without terms still stands beside the others; a language without kept terms has
value 0 for every pair; a language of one source has no pairs; equal values are
ranked by the item's UTF-8 bytes; repeated rows count as documents of their own;
an empty table gives an empty result; columns other than text, lang and source
are not read; of a very long text one task holds the words. A term's vector, and
a language's list of sources, must fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, rows_out, worker_keeps, written
from .urls import lower_ascii

#: Words are runs of letters and of everything outside ASCII; between them, where A-Z has become a-z, stands:
BETWEEN = r"[\x00-\x60\x7B-\x7F]+"
LEAST_DOCS = 10
SCALE = 1_000_000_000
SMOOTH = 2
TOP = 10
#: Sources whose pairs with all others one task sums up.
BLOCK = 256
#: Cells of a dense table of (vectors, sources) that a task works on.
CELLS = 1 << 19
KEY = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents that hold the term."""
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", *KEY)])
    # in a text of ASCII alone, lower() changes nothing but A-Z, and is much faster
    lower = F.when(F.octet_length("text") == F.length("text"), F.lower("text")).otherwise(lower_ascii(F.col("text")))
    words = given.select(*KEY, F.split(lower, BETWEEN).alias("_words"))
    # a document's words, then its distinct ones: both counts in one pass
    both = words.select(*KEY, F.posexplode(F.array("_words", F.array_distinct("_words"))).alias("_k", "_words"))
    return both.select(*KEY, "_k", F.explode("_words").alias("term")).where("term <> ''").groupBy(*KEY, "term").agg(F.count_if(F.col("_k") == 0).alias("n"), F.count_if(F.col("_k") == 1).alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(lang, term, members)`` of terms in enough documents; members are (source, n) by source."""
    members = F.array_sort(F.collect_list(F.struct("source", "n")))
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), members.alias("members")).where(F.col("_docs") >= least_docs).drop("_docs")


def share(n: Column, whole: Column) -> Column:
    """1 and the whole billionths of ``n + SMOOTH`` in ``whole``; null where that is 0."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)")
    return 1 + F.call_function("div", wide, F.nullif(whole, F.lit(0).cast("bigint")).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_facts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, whole, lang_whole, terms)`` of every group; whole is its words and the smoothing's."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in KEY]).distinct()
    used = kept.select("lang", F.explode("members").alias("_m")).groupBy("lang", F.col("_m.source").alias("source")).agg(F.sum("_m.n").alias("_n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    zero = F.lit(0).cast("bigint")
    found = groups.join(used, KEY, "left").join(sizes, "lang", "left").withColumns({"_n": F.coalesce("_n", zero), "terms": F.coalesce("terms", zero)})
    every = F.sum("_n").over(Window.partitionBy("lang"))
    return found.select(*KEY, (F.col("_n") + SMOOTH * F.col("terms")).alias("whole"), (every + SMOOTH * F.col("terms")).alias("lang_whole"), "terms")


def shares_of(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``share`` in 64 bits: long division by thousands, as ``n + SMOOTH <= whole < 9e15``."""
    rest, out = n + SMOOTH, np.zeros(len(n), np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


class _Block:
    """Sums over vectors for the pairs of one block's sources with all of their language."""

    def __init__(self, lang: str, low: int, size: int, cells: int, sources: pa.Array, whole: np.ndarray):
        self.lang, self.low, self.cells, self.sources, self.whole = lang, low, cells, sources, whole
        self.high = min(low + size, len(sources))
        self.base = shares_of(np.zeros(len(whole), np.int64), whole)
        self.sums = np.zeros((self.high - self.low, len(sources)), np.int64)

    def add(self, members: pa.Array, counts: pa.Array, times: np.ndarray) -> None:
        """Vectors as lists of sources and counts; ``times`` is how many terms have them."""
        step = max(1, self.cells // len(self.sources))
        for at in range(0, len(members), step):
            own = members.slice(at, step)
            place = pc.index_in(own.flatten(), value_set=self.sources).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
            shares = np.tile(self.base, (len(own), 1))
            shares[row, place] = shares_of(counts.slice(at, step).flatten().to_numpy(zero_copy_only=False).astype(np.int64), self.whole[place])
            there = np.zeros(shares.shape, bool)
            there[row, place] = True
            self._pairs(shares, there, times[at : at + step])

    def _pairs(self, shares: np.ndarray, there: np.ndarray, times: np.ndarray) -> None:
        """What vectors add to the pair's constant; a pair of which both have the term is met at its first source."""
        for s in range(self.low, self.high):
            rows = np.flatnonzero(there[:, s])
            if not len(rows):
                continue
            plain, p, n = _divergences(self.base[s], self.base), shares[rows, s][:, None], times[rows][:, None]
            later = (_divergences(p, shares[rows, s + 1 :]) - plain[s + 1 :]) * n
            self.sums[s - self.low, s + 1 :] += later.sum(axis=0)
            r, t = np.nonzero(~there[rows, :s])
            if len(r):
                np.add.at(self.sums[s - self.low], t, (_divergences(p[r, 0], self.base[t]) - plain[t]) * n[r, 0])

    def rows(self) -> Iterator[tuple]:
        names = self.sources.to_pylist()
        for s, t in zip(*np.nonzero(self.sums)):
            a, b = sorted((int(s) + self.low, int(t)))
            yield self.lang, names[a], names[b], int(self.sums[s, t])


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_PAIR = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def _summed(batches: Iterator[pa.RecordBatch], size: int, cells: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of block and salt, the first of each being the language's sources and wholes."""
    worker_keeps("divergence")

    def rows() -> Iterator[tuple]:
        held = None
        for batch in batches:
            first = batch.column("first").to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(first)
            cuts = [0, *heads.tolist(), len(batch)]
            for k, (at, end) in enumerate(zip(cuts, cuts[1:])):
                if k:
                    if held:
                        yield from held.rows()
                    names, whole = batch.column("sources")[at].values, batch.column("counts")[at].values
                    held = _Block(batch.column("lang")[at].as_py(), batch.column("block")[at].as_py() * size, size, cells, names, whole.to_numpy(zero_copy_only=False).astype(np.int64))
                    at += 1
                if held and end > at:
                    part = batch.slice(at, end - at)
                    held.add(part.column("sources"), part.column("counts"), part.column("times").to_numpy(zero_copy_only=False))
        if held:
            yield from held.rows()

    yield from rows_out(_PAIR, rows())


def pair_sums(vectors: DataFrame, facts: DataFrame) -> DataFrame:
    """``(lang, a, b, value)``, a before b: what the vectors add to the pairs' constants."""
    spark = vectors.sparkSession
    listed = facts.where("terms > 0").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "whole"))).alias("_all"))
    n_blocks = F.ceil(F.size("_all") / BLOCK).cast("int")
    blocks = listed.agg(F.coalesce(F.sum(n_blocks), F.lit(0))).first()[0]
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, blocks)))
    heads = listed.select("lang", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), F.transform("_all", lambda x: x["source"]).alias("sources"), F.transform("_all", lambda x: x["whole"]).alias("counts"))
    heads = heads.select("lang", "block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("first"), "sources", "counts", F.lit(0).cast("bigint").alias("times"))
    places = listed.select("lang", F.posexplode("_all").alias("_k", "_m")).select("lang", F.col("_m.source").alias("source"), F.floor(F.col("_k") / BLOCK).cast("int").alias("block"))
    numbered = vectors.select("lang", "vector", "members", "times")
    # a vector goes to the blocks of its own sources
    met = numbered.select("lang", "vector", F.explode("members.source").alias("source")).join(places, ["lang", "source"]).select("vector", "block").distinct()
    rows = numbered.join(met, "vector").select("lang", "block", F.pmod(F.xxhash64("vector"), F.lit(salts)).cast("int").alias("salt"), F.lit(False).alias("first"), F.col("members.source").alias("sources"), F.col("members.n").alias("counts"), "times")
    key = ["lang", "block", "salt"]
    dealt = heads.unionByName(rows).repartition(*key).sortWithinPartitions(*key, F.desc("first"))
    found = dealt.select("lang", "block", "first", "sources", "counts", "times").mapInArrow(partial(_summed, size=BLOCK, cells=CELLS), "lang string, a string, b string, value bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def pair_part(vectors: DataFrame, facts: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every ordered pair of sources of a language."""
    base = facts.withColumn("_base", share(F.lit(0).cast("bigint"), F.col("whole")))
    other = base.select("lang", F.col("source").alias("item"), F.col("_base").alias("_other"))
    pairs = base.select(*KEY, "terms", "_base").join(other, "lang").where(F.col("source") != F.col("item"))
    sums = pair_sums(vectors, facts).select("lang", F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("value").alias("_sum"))
    pairs = pairs.withColumns({"_a": F.least("source", "item"), "_b": F.greatest("source", "item")}).join(sums, ["lang", "_a", "_b"], "left")
    zero = F.lit(0).cast("bigint")
    value = F.coalesce(F.col("terms") * divergence(F.col("_base"), F.col("_other")), zero) + F.coalesce("_sum", zero)
    return pairs.select(*KEY, "item", value.alias("value"))


def term_part(kept: DataFrame, facts: DataFrame, top: int = TOP) -> DataFrame:
    """``(lang, source, item, value)`` of terms that a group uses more than its language, the first ``top``."""
    named = kept.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "members").orderBy("term"))).where(F.col("_n") <= top)
    every = F.aggregate("members", F.lit(0).cast("bigint"), lambda held, x: held + x["n"])
    used = named.select("lang", "term", every.alias("_every"), F.explode("members").alias("_m")).select("lang", F.col("_m.source").alias("source"), F.col("_m.n").alias("n"), "_every", F.col("term").alias("item"))
    told = used.join(facts, KEY).withColumns({"_p": share(F.col("n"), F.col("whole")), "_q": share(F.col("_every"), F.col("lang_whole"))}).where(F.col("_p") > F.col("_q"))
    return told.select(*KEY, "item", divergence(F.col("_p"), F.col("_q")).alias("value"))


def audited(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: all pairs of sources, the ``top`` terms of each group."""
    kept, kept_path = written(kept_terms(term_counts(docs), least_docs), "divergence-terms")
    facts, facts_path = written(group_facts(docs, kept), "divergence-groups")
    distinct = kept.groupBy("lang", "members").agg(F.count("*").alias("times")).withColumn("vector", F.monotonically_increasing_id())
    vectors, vectors_path = written(distinct, "divergence-vectors")
    parts = []
    for name, found, most in (("pair", pair_part(vectors, facts), None), ("term", term_part(kept, facts, top), top)):
        w = Window.partitionBy(*KEY).orderBy(F.desc("value"), "item")
        ranked = found.withColumn("rank", F.row_number().over(w))
        ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
        parts.append(ranked.select(*KEY, F.lit(name).alias("part"), "item", "value", "rank"))
    out, _ = written(parts[0].unionByName(parts[1]), "divergence")
    drop(docs.sparkSession, kept_path, facts_path, vectors_path)
    return out


def oracle() -> str:
    """The audit in DuckDB's SQL, over all terms one by one."""
    word = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '{word}')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
gt AS (SELECT g.lang, g.source, coalesce(t.n, 0) AS total, coalesce(v.v, 0) AS v FROM g LEFT JOIN t USING (lang, source) LEFT JOIN v USING (lang)),
lt AS (SELECT lang, sum(total) AS total, min(v) AS v FROM gt GROUP BY 1),
p AS (SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH}) // (gt.total + {SMOOTH} * gt.v) AS p FROM gt JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + {SCALE}::HUGEINT * (sum(n) + {SMOOTH}) // (max(lt.total) + {SMOOTH} * max(lt.v)) AS q FROM c JOIN lt USING (lang) GROUP BY 1, 2),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM u WHERE part = 'pair' OR rank <= {TOP}"""
