"""Token counts by a longest-match automaton, without building the pieces.

A vocabulary's byte strings form a trie. Each node holds where matching goes on
when the next byte has no edge (its failure link) and how many pieces that pops,
so greedy longest-match lengths come in time linear in the text.

A word is a run of bytes other than the six ASCII white-space characters; it is
matched with one space before it, as vocabularies mark the start of a word. The
vocabulary must hold every single byte, so every word has pieces.

Defined cases: a null or empty text, or one of white space only, has no words
and no pieces; a word of any length is matched as a whole, which takes no more
memory than the word itself, as pieces are counted and not kept; rows are independent,
so ties, repeats, null ids and other columns do not matter; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, worker_keeps

#: Words whose piece counts a worker remembers before it starts anew.
REMEMBER = 300_000
#: Longer words are counted but not remembered.
SHORT = 64


def byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary, by its rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def vocabulary(path: str, special: Iterable[str] = ("<|endoftext|>",)) -> list[bytes]:
    """The byte strings of a byte-level vocabulary file, special tokens left out."""
    with open(path, encoding="utf-8") as f:
        words = json.load(f)["model"]["vocab"]
    known = byte_of()
    return sorted(bytes(known[c] for c in w) for w in words if w not in set(special))


class Automaton:
    """A trie with failure links and the number of pieces that each one pops."""

    def __init__(self, words: Iterable[bytes]):
        edges: list[dict[int, int]] = [{}]
        ends = [False]
        parents = [(0, 0)]
        for word in words:
            at = 0
            for byte in word:
                to = edges[at].get(byte)
                if to is None:
                    to = edges[at][byte] = len(edges)
                    edges.append({})
                    ends.append(False)
                    parents.append((at, byte))
                at = to
            ends[at] = at > 0
        if any(b not in edges[0] or not ends[edges[0][b]] for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        self.edges = edges
        self.fail = [0] * len(edges)
        self.popped = [0] * len(edges)
        level = list(edges[0].values())
        while level:  # by depth: a node's link needs those of shorter strings
            for node in level:
                if ends[node]:
                    self.popped[node] = 1
                    continue
                parent, byte = parents[node]
                at, n = self.fail[parent], self.popped[parent]
                while byte not in edges[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                self.fail[node], self.popped[node] = edges[at][byte], n
            level = [to for node in level for to in edges[node].values()]

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match."""
        edges, fail, popped = self.edges, self.fail, self.popped
        at = n = 0
        for byte in word:
            to = edges[at].get(byte)
            while to is None:
                n += popped[at]
                at = fail[at]
                to = edges[at].get(byte)
            at = to
        while at:
            n += popped[at]
            at = fail[at]
        return n


class _Remembered(dict):
    """Piece counts of words met before."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= SHORT:
            self[word] = n
        return n


def _count_batches(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    kept = worker_keeps("wordpieces")
    if kept.get("words") != shared.value:  # one automaton for each worker and vocabulary
        kept.update(words=shared.value, known=_Remembered(Automaton(shared.value)))
    known = kept["known"]
    for batch in batches:
        n = len(batch)
        words_of, pieces_of, bytes_of = (np.zeros(n, np.int64) for _ in range(3))
        for k, text in enumerate(batch.column(1)):
            data = text.as_py()
            words = data.split()
            words_of[k], bytes_of[k] = len(words), len(data)
            pieces_of[k] = sum(map(known.__getitem__, words))
            if len(known) > REMEMBER:
                known.clear()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bytes_of), pa.array(words_of), pa.array(pieces_of)], ["doc_id", "n_bytes", "n_words", "n_tokens"])


def counted(docs: DataFrame, path: str) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, n_words, n_tokens)``.

    The driver reads the vocabulary file (fixed, under a few MB) and ships it.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_batches(batches, shared)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
