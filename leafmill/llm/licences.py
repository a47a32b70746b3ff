"""Licence statements and notices in texts, by a suffix automaton of their words.

The words of all templates make one generalised suffix automaton. A text's words
run through it once and give matching statistics: at each word the length of the
longest run ending there that stands in some template, and the automaton's state.
Runs that cannot go on and have at least ``LEAST`` words are matches; a template's
matches are chained, in order in text and template, over gaps of at most ``GAP``
words of the text (names, years, comment signs), and no more than the template has. A chain that covers enough of its
template is a span: all of a template of under ``LONG`` words, else ``COVER`` of it.
Of spans that overlap the one of more words stays, so of two versions of a notice
the one that is meant. Phrases are templates as well; they count at every place.

Words are runs of letters, digits and characters outside ASCII, A-Z lower-cased.

Defined cases: a null or empty text has no words, no labels and score 0; a null
doc_id keeps its row; repeated rows get equal results; spans of equally many words
are chosen by their start, then by label; an empty table gives an empty result;
other columns are not read. A very long text is gone through ``CHUNK`` bytes at a
time, with the state and the open chains carried on.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, rows_out, text_bytes, worker_keeps
from .licence_texts import PHRASES, templates

LEAST = 3
GAP = 24
LONG = 20
COVER = 0.8
CHUNK = 1 << 20

_WORDY = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Every byte as a word's, lower-cased, or as a blank; those outside ASCII are a word's.
_AS_WORDS = bytes(b if b >= 128 or b in _WORDY else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def word_chunks(data: bytes, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """A text's words, some at a time; no word is cut."""
    at, text = 0, data.translate(_AS_WORDS)
    while at < len(text):
        end = len(text) if len(text) - at <= chunk else text.rfind(b" ", at, at + chunk)
        if end < 0:
            end = text.find(b" ", at + chunk)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end + 1


def words_of(data: bytes) -> list[bytes]:
    return [w for words in word_chunks(data) for w in words]


class SuffixAutomaton:
    """Of several sequences; state 0 is the empty one."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(sequences):
            state = 0
            for k, word in enumerate(words):
                state = self._grown(state, word)
                ends.extend([] for _ in range(len(self.next) - len(ends)))
                ends[state].append((t, k + 1))
        # where a state's runs end: its own places and those of all states that have it as suffix
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                ends[self.link[state]] += ends[state]
        self.ends = [sorted(set(x)) for x in ends]

    def _new(self, length: int, follow: dict[bytes, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes) -> int:
        """The state of p's longest run and ``word``, set apart if it shares one with longer runs."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = own
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = own
            p = self.link[p]
        return own

    def _grown(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def state_of(self, words: list[bytes]) -> int:
        state = 0
        for word in words:
            state = self.next[state][word]
        return state


@dataclass
class _Told:
    """What a text shows: places of phrases, accepted chains, the largest share of a template."""

    n_words: int = 0
    places: list[tuple[int, str]] = field(default_factory=list)
    chains: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    best: float = 0.0


class Scanner:
    """Phrases and templates as one automaton; both are bounded parameters."""

    def __init__(self, phrases: dict[str, str], named: list[tuple[str, str]]):
        known = [(label, words_of(text.encode())) for label, text in named]
        said = [(label, words_of(text.encode())) for text, label in phrases.items()]
        known, said = ([x for x in own if x[1]] for own in (known, said))
        self.labels, self.sizes = [label for label, _ in known], [len(words) for _, words in known]
        self.wanted = [n if n < LONG else -(-n * int(100 * COVER) // 100) for n in self.sizes]
        self.automaton = SuffixAutomaton([words for _, words in [*known, *said]])
        a = self.automaton
        self.ends = [[x for x in own if x[0] < len(known)] for own in a.ends]
        own: dict[int, list[tuple[str, int]]] = {}
        for label, words in said:
            own.setdefault(a.state_of(words), []).append((label, len(words)))
        # a phrase ends wherever its state is the text's state or a suffix of it
        self.phrases: list[list[tuple[str, int]]] = [[] for _ in a.next]
        for state in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            self.phrases[state] = own.get(state, []) + (self.phrases[a.link[state]] if a.link[state] > 0 else [])

    def statistics(self, words: Iterator[bytes], state: int = 0, length: int = 0) -> Iterator[tuple[int, int]]:
        """(state, length) after each word, plainly; ``told`` does the same in one loop."""
        a = self.automaton
        for word in words:
            while state and word not in a.next[state]:
                state = a.link[state]
                length = a.length[state]
            if word in a.next[state]:
                state, length = a.next[state][word], length + 1
            yield state, length

    def told(self, data: bytes, chunk: int = CHUNK) -> _Told:
        out = _Told()
        follow, link, longest, phrases = self.automaton.next, self.automaton.link, self.automaton.length, self.phrases
        recent: dict[int, list[tuple[int, int, int, int]]] = {}
        state = length = at = 0
        root = follow[0]
        for words in word_chunks(data, chunk):
            for at, word in enumerate(words, out.n_words):
                if not state:
                    state = root.get(word, 0)
                    if not state:
                        continue
                    length = 1
                else:
                    if word not in follow[state]:
                        if length >= LEAST:
                            self._chained(out, recent, state, length, at)
                        while state and word not in follow[state]:
                            state = link[state]
                            length = longest[state]
                    state = follow[state].get(word, 0)
                    length = length + 1 if state else 0
                if phrases[state]:
                    out.places.extend((at + 1 - size, label) for label, size in phrases[state] if size <= length)
            out.n_words += len(words)
        if length >= LEAST:
            self._chained(out, recent, state, length, out.n_words)
        return out

    def _chained(self, out: _Told, recent: dict[int, list[tuple[int, int, int, int]]], state: int, length: int, end: int) -> None:
        """Put a match, ending before word ``end``, behind the template's chain that covers most."""
        start = end - length
        for t in {t for t, _ in self.ends[state]}:
            # (end in text, end in template, words, start) of chains that may still go on
            recent[t] = [x for x in recent.get(t, []) if x[0] >= start - min(GAP, self.sizes[t])]
        grown = []
        for t, t_end in self.ends[state]:
            words, first = length, start
            for prior_end, prior_t, covered, begun in recent[t]:
                # a match may begin within the prior one; both sides lose the same words
                more = length - max(0, prior_end - start, prior_t - (t_end - length))
                if more > 0 and covered + more > words:
                    words, first = covered + more, begun
            grown.append((t, (end, t_end, words, first)))
            out.best = max(out.best, words / self.sizes[t])
            if words >= self.wanted[t]:
                out.chains[t, first] = max(out.chains.get((t, first), (0, 0)), (words, end))
        for t, chain in grown:
            recent[t].append(chain)

    def spans(self, told: _Told) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, last word, words, share) of chains that overlap none of more words, in order."""
        ranked = sorted((-words, first, self.labels[t], end, t) for (t, first), (words, end) in told.chains.items())
        starts: list[int] = []
        kept: list[tuple[str, int, int, int, float]] = []
        for words, first, label, end, t in ranked:
            k = bisect_right(starts, first)
            if (k and kept[k - 1][2] >= first) or (k < len(kept) and kept[k][1] < end):
                continue
            starts.insert(k, first)
            kept.insert(k, (label, first, end - 1, -words, -words / self.sizes[t]))
        return kept


SPANS = "array<struct<label:string,first_word:bigint,last_word:bigint,n_words:bigint,share:double>>"


def scanned(docs: DataFrame, named: list[tuple[str, str]] | None = None, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)`` of every text.

    Templates ``named`` (label, text) and ``phrases`` (text, label) are parameters
    that a worker holds as one automaton, some hundred thousand words at most. The
    score is the largest share of one template that a chain covers, 1 for a phrase.
    """
    named = templates() if named is None else named
    key = repr((named, phrases))
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_keeps("licences")
        if held.get("key") != key:
            held.update(key=key, scanner=Scanner(phrases, named))
        scanner: Scanner = held["scanner"]

        def rows(part: pa.RecordBatch) -> Iterator[tuple]:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                told = scanner.told(text.as_py())
                found = scanner.spans(told)
                places = [at for at, _ in told.places]
                base = {label for _, label in told.places}
                labels = base | {x[0] for x in found}
                yield doc_id, told.n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else told.best, [dict(zip(("label", "first_word", "last_word", "n_words", "share"), x)) for x in found]

        for part in in_parts(batches):
            schema = pa.schema([("doc_id", part.schema.field(0).type), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
            yield from rows_out(schema, rows(part), lambda row: 100 + 100 * len(row[-1]))

    given = docs.select("doc_id", text_bytes())
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(scan, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPANS}")


def labelled(docs: DataFrame, named: list[tuple[str, str]] | None = None) -> DataFrame:
    """Spans one by one: ``(doc_id, label, first_word, last_word, n_words, share)``."""
    return scanned(docs, named).select("doc_id", F.explode("spans").alias("_s")).select("doc_id", "_s.*")
