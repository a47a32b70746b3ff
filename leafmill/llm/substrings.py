"""Substring dedup by relative Lempel-Ziv parsing against an indexed reference.

Every 50-word window holds one anchor: the least hash among its 19-word runs. The
windows of one anchor in a text are neighbours; the words that they span are a
stretch. The reference holds, for each anchor, the stretch of the least doc_id
that has it, and its index is the anchor: each hash partition of anchors is one
reference block. A text is parsed against every block that holds one of its
anchors; no other block can hold one of its windows.

1. A stretch whose anchor no other document has is a literal.
2. Elsewhere the anchor gives a place in the reference, and the factor is grown
   from there word by word, greedily, as far as text and reference agree in both
   directions. Where all stretches of an anchor have one hash of their words, the
   factor is the whole stretch and no words are read again.
3. Factors of 50 words or more are kept: their windows stand in the reference's
   document. As equal windows hold their anchor at the same place, no window of
   this anchor in the reference's stretch is missed by the one factor.
4. Windows that no factor holds cross a factor's boundary. They are compared with
   the like windows of all other documents, by anchor and a hash of their words.

The windows that an earlier document has are merged per text, and the words that
they cover are removed. Group-bys have map-side minima; no group is gathered
anywhere, however many documents share a passage. Words are compared as bytes in
step 2 where stretches differ, else by hashes of 128 bits in all.

Defined cases: a null or empty text has no words; texts under 50 words lose
nothing; repeated texts keep the words of the least doc_id only; rows that share
a doc_id are one document's, whether their texts are equal or not, and do not
remove each other's words; a null doc_id removes nothing and is not judged; a very
long text is hashed whole by one task, about 60 bytes for each of its words; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, in_parts, text_bytes, worker_keeps, written

WINDOW = 50
#: Words of an anchor: a window holds 32 of them, a power of two.
ANCHOR = 19
SPREAD = WINDOW - ANCHOR + 1
#: Windows of a text handled at a time.
SEGMENT = 1 << 19

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_word_hash = partial(xxhash.xxh64_intdigest, seed=7)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_hash, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of every run of ``length`` words, by doubling."""
    found = np.zeros(len(words) - length + 1, np.uint64)
    power, size, at = words, 1, 0
    factor, step = np.ones(1, np.uint64), np.full(1, _MULTIPLY)
    while size <= length:
        if length & size:
            found += factor * power[at : at + len(found)]
            at += size
            factor = factor * step
        if 2 * size <= length:
            power = power[:-size] + step * power[size:]
        step = step * step
        size *= 2
    return found


def stretch_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each stretch ``words[start:end]`` of its own length."""
    n = len(words)
    up = np.cumprod(np.r_[np.uint64(1), np.full(n, _MULTIPLY)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE)])
    sums = np.r_[np.uint64(0), np.cumsum(words * up[:n])]
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def anchored(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows, place of the anchor) of each stretch."""
    low = np.uint64(SEGMENT * 2 - 1)
    parts = []
    for start in range(0, len(words) - WINDOW + 1, SEGMENT):
        own = words[start : start + SEGMENT + WINDOW - 1]
        runs = mixed(run_hashes(own, ANCHOR))
        least = (runs & ~low) | np.arange(len(runs), dtype=np.uint64)
        size = 1
        while size < SPREAD:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        where = (least & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        parts.append((runs[where[first]], first + start, np.diff(np.append(first, len(where))), where[first] + start))
    if not parts:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


STRETCHES = ["doc_id", "mark", "anchor", "stretch", "first", "n", "at"]
STRETCHES_DDL = "doc_id long, mark long, anchor long, stretch long, first int, n int, at int"


def _stretch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_keeps("substrings")
    held, size = [], 0

    def out():
        columns = [np.concatenate(x) for x in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], STRETCHES)

    for batch in in_parts(batches):
        for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            words = text.as_py().split()
            if doc is None or len(words) < WINDOW:
                continue
            hashes = word_hashes(words)
            anchor, first, n, at = anchored(hashes)
            stretch = stretch_hashes(hashes, first, first + n + WINDOW - 1)
            ids = np.full(len(anchor), doc, np.int64), np.full(len(anchor), mark, np.int64)
            held.append((*ids, anchor.view(np.int64), stretch.view(np.int64), *(x.astype(np.int32) for x in (first, n, at))))
            size += len(anchor)
            if size > 1 << 17:
                yield out()
                held, size = [], 0
    if held:
        yield out()


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
ASKED = pa.list_(pa.struct([("anchor", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("least", pa.int64()), ("words", pa.binary())]))
RESULT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", SPANS), ("kept", pa.binary())]
RESULT_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,n:int>>, kept binary"
JUDGED = pa.schema([*RESULT, ("mark", pa.int64()), ("text", pa.binary()), ("copied", SPANS), ("asked", ASKED)])
JUDGED_DDL = f"{RESULT_DDL}, mark long, text binary, copied array<struct<first:int,n:int>>, asked array<struct<anchor:long,first:int,n:int,at:int,least:long,words:binary>>"


def remove(words: list[bytes], windows: list[tuple[int, int]]) -> tuple[int, list[dict], bytes]:
    """(words removed, their spans, what stays) for runs of (first window, windows)."""
    if not windows:
        return 0, [], b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for first, n in windows:
        steps[first] += 1
        steps[first + n + WINDOW - 1] -= 1
    gone = np.cumsum(steps[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0])).reshape(-1, 2).tolist()
    kept, at = [], 0
    for a, b in edges:
        kept += words[at:a]
        at = b
    return int(gone.sum()), [{"first": a, "n": b - a} for a, b in edges], b" ".join(kept + words[at:])


def _result(doc: int | None, words: list[bytes], windows: list[tuple[int, int]], whole: bool) -> tuple:
    n, spans, kept = remove(words, windows)
    return doc, len(words), n, hashlib.sha256(kept).hexdigest(), spans, kept if whole else None


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def _judge_batches(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, text, spans) -> the result, or the stretches to factor and the text."""
    worker_keeps("substrings")
    rows, size = [], 0
    for batch in in_parts(batches):
        for doc, mark, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            data, spans = text.as_py(), spans.as_py() or ()
            words = data.split()
            copied = [(s["first"], s["n"]) for s in spans if s["copied"]]
            unsure = [s for s in spans if not s["copied"]]
            if unsure:
                asked = [{k: s[k] for k in ("anchor", "first", "n", "least")} | {"at": s["at"] - s["first"], "words": b" ".join(words[s["first"] : s["first"] + s["n"] + WINDOW - 1])} for s in unsure]
                rows.append((doc, *[None] * 5, mark, data, [{"first": a, "n": n} for a, n in copied], asked))
                size += len(data) + 600 * len(asked)
            else:
                rows.append((*_result(doc, words, copied, whole), *[None] * 4))
                size += 100 + len(data) * whole
            if size > 4 << 20:
                yield _rows(rows, JUDGED)
                rows, size = [], 0
    if rows:
        yield _rows(rows, JUDGED)


FACTORS = ["doc_id", "mark", "anchor", "first", "n", "window"]
FACTORS_DDL = "doc_id long, mark long, anchor long, first int, n int, window long"


def agreement(text: list[bytes], at: int, reference: list[bytes], place: int) -> tuple[int, int]:
    """The longest factor through ``text[at]``, as [start, end), that the reference holds around ``place``."""
    start, end = at, at
    for x, y in zip(text[at:], reference[place:]):
        if x != y:
            break
        end += 1
    for x, y in zip(reversed(text[:at]), reversed(reference[:place])):
        if x != y:
            break
        start -= 1
    return start, end


def _factor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches beside their reference -> windows that a factor holds, and the others with a hash each."""
    worker_keeps("substrings")
    held, reference = None, []
    for batch in in_parts(batches, 4096):
        copied, crossing, hashes = [], [], []
        for doc, mark, anchor, first, n, at, least, data, place, other in zip(*(c.to_pylist() for c in batch.columns)):
            words = data.split(b" ")
            if other != held:
                held, reference = other, other.split(b" ")
            start, end = agreement(words, at, reference, place)
            low, high = max(0, start), min(n, end - WINDOW + 1)  # windows that the factor holds
            if low >= high:
                low = high = n
            elif doc > least:
                copied.append((doc, mark, anchor, first + low, high - low))
            if high - low < n:
                crossing.append((doc, mark, anchor, first, n, low, high))
                hashes += map(_word_hash, words)
        columns = [np.array(x, np.int64) for x in zip(*copied)] or [np.empty(0, np.int64)] * 5
        windows = np.full(len(columns[0]), 0, np.int64)
        if crossing:
            own = [np.array(x, np.int64) for x in zip(*crossing)]
            first, n, low, high = own[3:]
            places = np.repeat(np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1) - (np.cumsum(n) - n), n) + np.arange(n.sum())
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            apart = (inside < np.repeat(low, n)) | (inside >= np.repeat(high, n))
            found = mixed(run_hashes(np.array(hashes, np.uint64), WINDOW))[places[apart]].view(np.int64)
            more = [*(np.repeat(x, n)[apart] for x in own[:3]), (np.repeat(first, n) + inside)[apart], np.zeros(len(found), np.int64)]
            columns, windows = [np.r_[x, y] for x, y in zip(columns, more)], np.r_[windows, found]
        if len(windows):
            kinds = [np.int64, np.int64, np.int64, np.int32, np.int32]
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(k)) for x, k in zip(columns, kinds)), pa.array(windows)], FACTORS)


def _finish_batches(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    worker_keeps("substrings")
    for batch in in_parts(batches):
        rows = []
        for doc, text, copied, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
            windows = [(s["first"], s["n"]) for s in [*(copied.as_py() or ()), *(found.as_py() or ())]]
            rows.append(_result(doc, text.as_py().split(), windows, whole))
        yield _rows(rows, pa.schema(RESULT))


def deduplicated(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_words, n_removed, kept_sha256, spans)``.

    ``spans`` are the removed runs of words, (first, n). whole: also ``kept``, the
    UTF-8 bytes of what stays.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), text_bytes())
    stretches, stretches_path = written(texts.mapInArrow(_stretch_batches, STRETCHES_DDL), "stretches")
    shared = stretches.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("stretch").alias("s0"), F.max("stretch").alias("s1"))
    # written, so that both sides of the join are dealt out and Spark splits a hot anchor
    shared, shared_path = written(shared.where("least < most").select("anchor", "least", (F.col("s0") == F.col("s1")).alias("copied")), "shared")
    met = stretches.join(shared, "anchor").where("not copied or doc_id > least")
    spans = met.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "n", "at", "anchor", "least", "copied")).alias("spans"))
    asked_of = texts.join(spans, ["doc_id", "mark"], "left").select("doc_id", "mark", "text", "spans")
    judged, judged_path = written(asked_of.mapInArrow(partial(_judge_batches, whole=whole), JUDGED_DDL), "judged")
    drop(spark, stretches_path, shared_path)

    asked = judged.where("asked is not null").select("doc_id", "mark", F.explode("asked").alias("s")).select("doc_id", "mark", "s.*")
    of_least = asked.where("doc_id = least").groupBy("anchor").agg(F.min_by(F.struct("at", "words"), F.struct("mark", "first")).alias("r"))
    reference, reference_path = written(of_least.select("anchor", F.col("r.at").alias("place"), F.col("r.words").alias("other")), "reference")
    beside = asked.join(reference, "anchor").select("doc_id", "mark", "anchor", "first", "n", "at", "least", "words", "place", "other")
    factors, factors_path = written(beside.mapInArrow(_factor_batches, FACTORS_DDL), "factors")
    crossing = factors.where("n = 0")
    earliest = crossing.groupBy("anchor", "window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    earliest, earliest_path = written(earliest.select("anchor", "window", "least"), "earliest")
    again = crossing.join(earliest, ["anchor", "window"]).where("doc_id > least").select("doc_id", "mark", "first", F.lit(1).alias("n"))
    found = factors.where("n > 0").select("doc_id", "mark", "first", "n").unionByName(again)
    found, _ = written(found.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "n")).alias("found")), "found")
    drop(spark, reference_path, factors_path, earliest_path)
    late = judged.where("asked is not null").select("doc_id", "mark", "text", "copied").join(found, ["doc_id", "mark"], "left")
    late = late.select("doc_id", "text", "copied", "found").mapInArrow(partial(_finish_batches, whole=whole), RESULT_DDL)
    out = judged.where("asked is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept").unionByName(late)
    return out if whole else out.drop("kept")


def oracle() -> str:
    """The same rows by every window of every document, on DuckDB; doc_ids are distinct and not null."""
    return r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS k FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM i),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY 1),
g AS (SELECT DISTINCT doc_id, k + o AS p FROM (SELECT doc_id, k, unnest(generate_series(0, 49)) AS o FROM h JOIN f USING (h) WHERE first < doc_id)),
r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, n: NOT list_contains(gone, n)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)"""
