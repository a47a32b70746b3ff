"""Language ID: a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time. Gates are
piecewise linear (clipped), so inference is matrix products and clips. It reads a
text in windows of 64 bytes, labels every position of every window, and a
document's probabilities are the mean of its positions'.

Training sees a bounded sample of labelled documents (``Bounds``): those whose
crc32(doc_id as text) mod 4 is not 2, chosen by a hash of doc_id, and of each a
few windows spread evenly over the text. Everything else covers all documents.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a
null doc_id is not held out and not learned from; of languages of equal
probability the first by name is told; null languages are not learned
from; with no labelled document every text is ``und``; repeated rows get equal
results; an empty table gives an empty result; other columns are not read; of a
very long text 2,048 windows are looked at together, and all of them count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, text_bytes, together, unused_name, worker_keeps

WINDOW = 64
HIDDEN = 8
UNKNOWN = "und"
#: Windows that step together.
LANES = 2048
HELD_OUT = 2


@dataclass(frozen=True)
class Bounds:
    """What training may read and do."""

    documents: int = 4000
    windows: int = 4
    epochs: int = 6
    steps: int = 400  # more epochs where these are not reached
    lanes: int = 256
    rate: float = 0.01
    seed: int = 11


class Network:
    """Weights of both directions and of the labels, gates' order: keep, reset, new."""

    def __init__(self, labels: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.labels = labels
        self.weights: dict[str, np.ndarray] = {}
        for side in "fb":
            self.weights[f"in_{side}"] = draw(256, 3 * h, scale=0.3)
            self.weights[f"in_{side}"][:, : 2 * h] += 0.5
            self.weights[f"re_{side}"] = draw(h, 3 * h, scale=0.3)
            self.weights[f"out_{side}"] = draw(h, len(labels), scale=0.3)
        self.weights["bias"] = np.zeros(len(labels), np.float32)

    def states(self, codes: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, lanes, H) of one direction over codes (T, lanes)."""
        h, table, back = HIDDEN, self.weights[f"in_{side}"], self.weights[f"re_{side}"]
        steps, lanes = codes.shape
        out = np.empty((steps, lanes, h), np.float32)
        state = np.zeros((lanes, h), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            fed = table.take(codes[t], axis=0)
            own = state @ back
            raw = fed[:, : 2 * h] + own[:, : 2 * h]
            gates = np.clip(raw, 0, 1)
            fresh = fed[:, 2 * h :] + gates[:, h:] * own[:, 2 * h :]
            new = np.clip(fresh, -1, 1)
            if keep is not None:
                keep.append((t, state, own, raw, gates, fresh, new))
            state = new + gates[:, :h] * (state - new)
            out[t] = state
        return out

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Label probabilities (T, lanes, labels) of every position."""
        w = self.weights
        logits = self.states(codes, "f") @ w["out_f"]
        logits += self.states(codes, "b") @ w["out_b"]
        logits += w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, codes: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions, and its gradients through time."""
        w, h, total = self.weights, HIDDEN, max(1.0, float(mask.sum()))
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        kept: dict[str, list] = {"f": [], "b": []}
        states = {s: self.states(codes, s, kept[s]) for s in "fb"}
        logits = states["f"] @ w["out_f"] + states["b"] @ w["out_b"] + w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        lanes = np.arange(codes.shape[1])
        right = p[:, lanes, labels]
        loss = float(-(np.log(np.maximum(right, 1e-9)) * mask).sum() / total)
        p[:, lanes, labels] -= 1
        p *= (mask / total)[:, :, None].astype(np.float32)
        grads["bias"] = p.sum(axis=(0, 1))
        for s in "fb":
            grads[f"out_{s}"] = np.tensordot(states[s], p, axes=((0, 1), (0, 1)))
            fed_back = p @ w[f"out_{s}"].T
            carried = np.zeros((codes.shape[1], h), np.float32)
            back = w[f"re_{s}"]
            for t, before, own, raw, gates, fresh, new in reversed(kept[s]):
                d = fed_back[t] + carried
                hold, reset = gates[:, :h], gates[:, h:]
                d_new = d * (1 - hold) * (np.abs(fresh) < 1)
                d_raw = np.concatenate([d * (before - new), d_new * own[:, 2 * h :]], axis=1) * ((raw > 0) & (raw < 1))
                d_own = np.concatenate([d_raw, d_new * reset], axis=1)
                d_fed = np.concatenate([d_raw, d_new], axis=1)
                np.add.at(grads[f"in_{s}"], codes[t], d_fed)
                grads[f"re_{s}"] += before.T @ d_own
                carried = d * hold + d_own @ back.T
        return loss, grads


def train(windows: list[bytes], languages: list[str], bounds: Bounds = Bounds()) -> Network | None:
    """Adam over shuffled lanes; None without examples."""
    labels = sorted(set(languages))
    if not labels:
        return None
    net = Network(labels, bounds.seed)
    at = {x: k for k, x in enumerate(labels)}
    wanted = np.array([at[x] for x in languages])
    codes = np.zeros((len(windows), WINDOW), np.uint8)
    for k, x in enumerate(windows):
        codes[k, : len(x)] = np.frombuffer(x, np.uint8)
    mask = np.arange(WINDOW) < np.array([len(x) for x in windows])[:, None]
    rng = np.random.default_rng(bounds.seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    each = -(-len(windows) // bounds.lanes)
    epochs = max(bounds.epochs, -(-bounds.steps // each))
    step, total = 0, epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), bounds.lanes):
            own = order[start : start + bounds.lanes]
            _, grads = net.gradients(codes[own].T, mask[own].T.astype(np.float32), wanted[own])
            step += 1
            rate = bounds.rate * (1 - step / (total + 1))
            norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
            for k, g in grads.items():
                g = g / max(1.0, norm)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities of all positions of each non-empty text."""
    lengths = np.array([len(x) for x in texts], np.int64)
    counts = -(-lengths // WINDOW)
    total = np.zeros((len(texts), len(net.labels)))
    padded = b"".join(x + bytes(-len(x) % WINDOW) for x in texts)
    codes = np.frombuffer(padded, np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    last = np.cumsum(counts) - 1
    full = np.full(len(codes), WINDOW)
    full[last] = lengths - (counts - 1) * WINDOW
    for start in range(0, len(codes), LANES):
        own = slice(start, start + LANES)
        p = net.probabilities(np.ascontiguousarray(codes[own].T))
        for lane in np.flatnonzero(full[own] < WINDOW):
            p[full[own][lane] :, lane] = 0
        sums = p.sum(axis=0, dtype=np.float64)
        cuts = np.flatnonzero(np.r_[True, owner[own][1:] != owner[own][:-1]])
        total[owner[own][cuts]] += np.add.reduceat(sums, cuts, axis=0)
    return total / lengths[:, None]


def _predict_batches(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    worker_keeps("language")
    for batch in in_parts(batches, 4096):
        languages = np.full(len(batch), UNKNOWN, object)
        scores = np.zeros(len(batch))
        lettered = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False))
        texts = batch.column(1)
        start = 0
        while net is not None and start < len(lettered):
            own, held, size = [], [], 0
            while start < len(lettered) and size < 1 << 20:
                own.append(lettered[start])
                held.append(texts[int(lettered[start])].as_py())
                size += len(held[-1])
                start += 1
            p = document_probabilities(net, held)
            best = p.argmax(axis=1)
            languages[own] = [net.labels[k] for k in best]
            scores[own] = np.round(np.clip(p.max(axis=1), 0, 1), 4)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(languages.tolist(), pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])


def held_out() -> F.Column:
    """Whether a document is kept from training; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def training_windows(docs: DataFrame, bounds: Bounds = Bounds()) -> tuple[list[bytes], list[str]]:
    """Windows and languages of a bounded sample of the labelled documents that aren't held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out())
    labelled = labelled.select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("long"), F.lit("language")).alias("draw"), text_bytes())
    there = labelled.count()
    share = min(1.0, 4 * bounds.documents / max(1, there))
    drawn = labelled.where(F.pmod("draw", F.lit(1 << 30)) <= int(share * (1 << 30)))
    room = F.greatest(F.octet_length("text") - WINDOW, F.lit(0))
    places = [(1 + F.floor(room * k / max(1, bounds.windows - 1))).cast("int") for k in range(bounds.windows)]
    windows = F.array(*(F.substring("text", place, WINDOW) for place in places))
    rows = drawn.orderBy("draw", "doc_id").limit(bounds.documents).select("lang", windows.alias("windows")).collect()
    pairs = [(bytes(x), r.lang) for r in rows for x in dict.fromkeys(map(bytes, r.windows))]
    return [x for x, _ in pairs], [y for _, y in pairs]


def fitted(docs: DataFrame, bounds: Bounds = Bounds()) -> Network | None:
    return train(*training_windows(docs, bounds), bounds)


def identified(docs: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """``docs(doc_id, text, lang)`` -> ``(doc_id, held_out, lang_pred, score)``."""
    net = fitted(docs, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _predict_batches(batches, net)

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(), held_out().alias("held_out"), lettered.alias("lettered"))
    return asked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


#: Prefixes of held-out texts, in bytes, that show what a text of at least that length looks like; no text is longer than twice the last.
PREFIXES = [4 << k for k in range(29)]
#: Fewest held-out prefixes and whole texts of a length that bound it; others take the next shorter length's bounds.
WITNESSES = 30
#: Steps of scores (as they are told) and of log-probabilities that held-out prefixes are counted by.
FINE = (10_000, 1_000)
#: Bytes of held-out texts that are judged together.
JUDGED_BLOCK = 1 << 20
#: Bytes of learned texts whose pairs are counted together.
PAIRS_BLOCK = 1 << 20


class Evidence:
    """How scores and byte pairs of held-out texts lie, by length.

    A held-out text shows it by its prefixes and as a whole. ``score``: of those
    whose language was told right; ``pairs``: the
    log-probability of their byte pairs in the learned language that a pair fits
    best, as counted on all learned texts. Each bound is the median less twice its distance to the
    1 % quantile: far below what learned languages show, whatever their number.
    A text between two lengths has the lower bounds of both. A score above a half
    is never too low: where held-out scores are all near 1 their spread says little.
    """

    def __init__(self, counts: np.ndarray):
        single = counts.sum(axis=1) + 0.05
        single /= single.sum(axis=1, keepdims=True)
        smooth = counts + 8 * single[:, None, :]
        self.table = np.log(smooth / smooth.sum(axis=2, keepdims=True)).max(axis=0).astype(np.float32)
        self.bounds = np.full((len(PREFIXES), 2), -np.inf)

    def bounded(self, seen: dict[tuple[int, int], dict[int, int]]) -> Evidence:
        """With bounds by (place in ``PREFIXES``, 0 for scores and 1 for pairs, of whole texts 2 and 3) -> step -> number of them."""
        for k in range(len(PREFIXES)):
            both = [Counter(seen.get((k, side), {})) + Counter(seen.get((k, side + 2), {})) for side in range(2)]
            if both[0].total() < WITNESSES:
                self.bounds[k] = self.bounds[k - 1] if k else -np.inf
                continue
            for side in range(2):
                steps = np.array(sorted(both[side]))
                total = np.cumsum([both[side][x] for x in steps])
                middle, low = (steps[np.searchsorted(total, share * total[-1])] / FINE[side] for share in (0.5, 0.01))
                self.bounds[k, side] = middle - 2 * (middle - low)
        self.bounds[:-1] = np.minimum(self.bounds[:-1], self.bounds[1:])
        self.bounds[-1] = np.minimum(self.bounds[-1], self.bounds[-2])
        self.bounds[:, 0] = np.minimum(self.bounds[:, 0], 0.5)
        return self

    def pairs(self, text: bytes) -> float:
        """Of a text's windows the middle one's mean, so that a part does not decide for the whole."""
        own = np.frombuffer(text, np.uint8)
        if len(own) < 2:
            return 0.0
        each = self.table[own[:-1], own[1:]]
        starts = np.arange(0, max(1, len(each) - WINDOW // 2), WINDOW)
        return float(np.median(np.add.reduceat(each, starts) / np.diff(np.r_[starts, len(each)])))

    def accepts(self, text: bytes, score: float) -> bool:
        k = place_of(len(text))
        return k < 0 or (score >= self.bounds[k, 0] and self.pairs(text) >= self.bounds[k, 1])


def place_of(size: int) -> int:
    """The place in ``PREFIXES`` of the longest one that a text of ``size`` bytes has; -1 if it has none."""
    return min(len(PREFIXES), size.bit_length() - 2) - 1


def shown_probabilities(net: Network, texts: list[bytes]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(place in ``PREFIXES``, whole, numbers of texts, probabilities): of the prefixes of texts that are as long, and of whole texts between two lengths.

    A text is gone through once, from one prefix's end to the next one's, with the
    rest at last; only prefixes shorter than a window are looked at by themselves.
    """
    cuts = [[0, *(size for size in PREFIXES if WINDOW <= size < len(x)), len(x)] for x in texts]
    firsts = np.cumsum([0, *(len(own) - 1 for own in cuts)])
    parts = [x[start:end] for x, own in zip(texts, cuts) for start, end in zip(own, own[1:])]
    ends = np.array([end for own in cuts for end in own[1:]], np.int64)
    total = np.zeros((len(parts), len(net.labels)))
    if parts:
        total = document_probabilities(net, parts) * np.array([len(x) for x in parts])[:, None]
    for start, end in zip(firsts, firsts[1:]):
        np.cumsum(total[start:end], axis=0, out=total[start:end])
    sizes, places = np.array([len(x) for x in texts], np.int64), np.array([place_of(len(x)) for x in texts], np.int64)
    for k in range(places.max(initial=-1) + 1):
        own, size = np.flatnonzero(sizes >= PREFIXES[k]), PREFIXES[k]
        if size < WINDOW:
            yield k, False, own, document_probabilities(net, [texts[i][:size] for i in own])
        else:
            yield k, False, own, total[firsts[own] + k - PREFIXES.index(WINDOW)] / size
        own = np.flatnonzero((places == k) & (sizes > size))
        if len(own):
            last = firsts[own + 1] - 1
            yield k, True, own, total[last] / ends[last][:, None]


def prefix_probabilities(net: Network, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place in ``PREFIXES``, texts that are as long, probabilities of their prefixes)."""
    return ((k, own, p) for k, whole, own, p in shown_probabilities(net, texts) if not whole)


def pair_counts(docs: DataFrame, labels: list[str]) -> np.ndarray:
    """Byte pairs of all learned texts, whole, by language: (labels, 256, 256), summed in tasks."""
    at = {x: k for k, x in enumerate(labels)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(labels), 1 << 16), np.int64)
        for batch in in_parts(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(text.as_py(), np.uint8).astype(np.uint16)
                for start in range(0, len(own) - 1, PAIRS_BLOCK):
                    part = own[start : start + PAIRS_BLOCK + 1]
                    codes = part[:-1] << np.uint16(8) | part[1:]
                    if len(codes) < 4096:
                        np.add.at(total[at[lang]], codes, 1)
                    else:
                        total[at[lang]] += np.bincount(codes, minlength=1 << 16)
        lang, code = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int64)), pa.array(code.astype(np.int64)), pa.array(total[lang, code])], ["label", "code", "n"])

    learned = docs.where(F.col("lang").isin(labels) & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out()).select("lang", text_bytes())
    out = np.zeros((len(labels), 1 << 16))
    for r in learned.mapInArrow(count, "label long, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.label, r.code] = r.n  # at most 65,536 rows a language
    return out.reshape(-1, 256, 256)


def held_out_steps(docs: DataFrame, net: Network, known: Evidence) -> dict[tuple[int, int], dict[int, int]]:
    """How many prefixes of all held-out texts, and how many of them whole, told right, have which score and which log-probability, by steps.

    Sides 0 and 1 are scores and log-probabilities of prefixes, 2 and 3 those of
    whole texts longer than their longest prefix: every byte of a text counts.
    """
    at = {x: k for k, x in enumerate(net.labels)}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("language")
        total: dict[tuple[int, int, int], int] = {}
        for languages, texts in together(in_parts(batches), JUDGED_BLOCK):
            wanted = np.array([at[x] for x in languages])
            for k, whole, own, p in shown_probabilities(net, texts):
                right = np.flatnonzero(p.argmax(axis=1) == wanted[own])
                pairs = [known.pairs(texts[own[i]] if whole else texts[own[i]][: PREFIXES[k]]) for i in right]
                for side, values in enumerate((p.max(axis=1)[right], pairs), 2 * whole):
                    for step, n in zip(*np.unique(np.floor(np.asarray(values) * FINE[side % 2] + 1e-6).astype(np.int64), return_counts=True)):
                        total[k, side, int(step)] = total.get((k, side, int(step)), 0) + int(n)
        rows = list(total)
        yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in rows], pa.int64()) for c in range(3)), pa.array([total[r] for r in rows], pa.int64())], ["prefix", "side", "step", "n"])

    asked = docs.where(F.col("lang").isin(net.labels) & (F.length("text") > 0) & held_out() & F.col("text").rlike(r"\p{L}")).select("lang", text_bytes())
    seen: dict[tuple[int, int], dict[int, int]] = {}
    # steps are bounded by their fineness, whatever the number of texts
    for r in asked.mapInArrow(judge, "prefix long, side long, step long, n long").groupBy("prefix", "side", "step").agg(F.sum("n").alias("n")).toLocalIterator():
        seen.setdefault((r.prefix, r.side), {})[r.step] = r.n
    return seen


def evidence(docs: DataFrame, bounds: Bounds = Bounds()) -> tuple[Network | None, Evidence | None]:
    """The trained network, and what all learned texts' byte pairs and all held-out texts show under it."""
    net = fitted(docs, bounds)
    if net is None:
        return None, None
    known = Evidence(pair_counts(docs, net.labels))
    return net, known.bounded(held_out_steps(docs, net, known))


def _keep_batches(batches: Iterator[pa.RecordBatch], net: Network | None, known: Evidence | None) -> Iterator[pa.RecordBatch]:
    """Whole rows, the text's UTF-8 bytes read in place, those that are accepted."""
    for batch in in_parts(batches):
        texts = batch.column("text").cast(pa.binary())
        filled = pa.compute.fill_null(texts, b"")
        n, lettered = pa.array(np.zeros(len(batch), np.int64)), batch.column(batch.num_columns - 1)
        judged = pa.RecordBatch.from_arrays([n, filled, lettered, lettered], ["doc_id", "text", "held_out", "lettered"])
        for found in _predict_batches(iter([judged]), net):
            told = zip(filled, found.column("lang_pred").to_pylist(), found.column("score").to_pylist())
            good = [lang != UNKNOWN and known.accepts(text.as_py(), score) for text, lang, score in told]
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(good, pa.bool_()))


def recognised(docs: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """The rows of ``docs`` whose text is of a learned language, as they are.

    Texts without a letter go, and those whose score or byte pairs lie outside
    what held-out texts of their length show (``Evidence``). With fewer
    than ``WITNESSES`` held-out texts nothing with a letter goes; texts below 4
    bytes are not judged.
    """
    import pyarrow.compute  # noqa: F401

    net, known = evidence(docs, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        return _keep_batches(batches, net, known)

    return docs.withColumn(unused_name(docs, "lettered"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, docs.schema)
