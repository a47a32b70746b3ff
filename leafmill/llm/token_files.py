"""Token ids in files: frequency ranks, byte-aligned, control bytes apart.

A file holds whole documents in ascending doc_id order: the magic, a header, the
doc_ids, their token counts, the ids by descending frequency in this file, then
blocks of coded tokens and a checksum. A token is its id's rank in one to four
bytes; the lengths of four tokens share one control byte, and all control bytes
of a block stand before its data, so numpy decodes a block by table lookup.

Files are written by the tasks that encode, under names that follow the order of
doc_id, first beside and then moved to their place, so a repeated task replaces
its own file. What holds for all documents is not gathered: a file has its own
ranks, and documents' starts come from a running sum over the files.

Defined cases: a null text is empty and gets the end id only; a null doc_id sorts
first and stays null; rows that share a doc_id follow each other, ordered by
text; an empty table gives no file and an empty result; other columns are not
read; a text of any length stays in one file.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import local_path, new_path, together, worker_keeps, written
from .lookup import Lookup

END_ID = 2
MAGIC = b"LMTIDS01"
HEADER = struct.Struct("<8sIIQQQ")
SUFFIX = ".lmt"
#: A file is closed when it holds so many tokens; blocks are coded one by one.
FILE_TOKENS = 1 << 24
BLOCK_TOKENS = 1 << 20
NO_ID = -(1 << 63)
#: Pre-tokens, and words, whose ids a worker remembers in each generation.
REMEMBER = 1_000_000
#: Characters of text that are encoded together.
TOGETHER = 3 << 20
#: Fixed value: how the byte-level vocabulary splits a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with a special token's name, or with characters that libraries class differently, are encoded whole.
WHOLE = r"<\|endoftext\|>|[\x1c-\x1f\x85\u180e\u200b\ufeff]"

#: White space other than a space and a line end.
ODD_SPACES = "\t\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts that hold one of these are split by pattern.
UNEVEN = ["\0", "  ", "\n\n", " \n", "\n ", *ODD_SPACES, "<|endoftext|>", *"\x1c\x1d\x1e\x1f\u180e\u200b\ufeff"]

LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def coded(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of a block of uint32 values."""
    most = int(ranks.max(initial=0))
    sizes = np.ones(len(ranks), np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        if most > limit:
            sizes += ranks > limit
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    width = 2 if most <= 0xFFFF else 4
    data = ranks.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[np.arange(width, dtype=np.uint8) < sizes[:, None]]
    return control.tobytes(), data.tobytes()


def decoded(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The block's uint32 values, by table lookup of the control bytes."""
    sizes = LENGTHS[control].ravel()[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    if n and int(ends[-1]) != len(data):
        raise ValueError("control and data bytes disagree")
    more = np.concatenate([data, np.zeros(3, np.uint8)])
    values = more[starts].astype(np.uint32)
    for k in range(1, int(sizes.max(initial=1))):
        values |= more[starts + k].astype(np.uint32) << 8 * k
    return values & MASKS[sizes]


def file_parts(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
    """The bytes of a file, block by block."""
    often = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    order = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
    rank_of = np.zeros(len(often), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    check = 0
    blocks = -(-len(ids) // BLOCK_TOKENS)
    head = HEADER.pack(MAGIC, 1, BLOCK_TOKENS, len(doc_ids), len(ids), len(order))
    parts = [head, doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), order.astype("<u4").tobytes()]
    for k in range(blocks + 1):
        for part in parts:
            check = zlib.crc32(part, check)
            yield part
        if k < blocks:
            control, data = coded(rank_of[ids[k * BLOCK_TOKENS : (k + 1) * BLOCK_TOKENS]])
            parts = [struct.pack("<Q", len(data)), control, data]
    yield struct.pack("<I", check)


def read_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a file's bytes."""
    magic, version, block, docs, tokens, ranks = HEADER.unpack_from(content)
    if magic != MAGIC or version != 1 or zlib.crc32(memoryview(content)[:-4]) != struct.unpack("<I", content[-4:])[0]:
        raise ValueError("not a token file, or a damaged one")
    at = HEADER.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(content, kind, n, at)
        at += found.nbytes
        return found

    doc_ids, counts, order = take("<i8", docs), take("<i8", docs), take("<u4", ranks)
    ids = np.empty(tokens, np.uint32)
    for start in range(0, tokens, block):
        n = min(block, tokens - start)
        size = int(take("<u8", 1)[0])
        control = take("u1", -(-n // 4))
        ids[start : start + n] = order[decoded(control, take("u1", size), n)]
    return doc_ids, counts, ids


class Encoder:
    """Texts to ids by the tokenizers library's model.

    The ids of a pre-token depend on it alone. In a text whose words stand apart
    by single spaces or line ends, the ids of a word depend on it and on the space
    before it alone: such texts are cut to words, a batch's distinct words are
    looked up or encoded once, and the ids are gathered by numpy. Any other text
    is cut to pre-tokens as the library does, which are looked up likewise.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        from .wordpieces import byte_of

        self.tokenizer = Tokenizer.from_str(definition)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.shown = {b: c for c, b in byte_of().items()}
        self.space = self.shown[32]
        self.split = regex.compile(SPLIT).findall
        self.odd = regex.compile(WHOLE).search
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # what it would remember is remembered here
        self.merge = model.tokenize
        self.pieces = Lookup(self.kind, self._merged, REMEMBER)
        self.words = Lookup(self.kind, self._learn, REMEMBER)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", self.space)
        else:
            shown = piece.encode().decode("latin-1").translate(self.shown)
        return array(self.code, [x.id for x in self.merge(shown)]).tobytes()

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._piece(x) for x in pieces]
        return np.frombuffer(b"".join(found), self.kind), np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words together, line ends between them: those are pre-tokens."""
        if "\n" in words:
            at = words.index("\n")
            (before, n), own, (after, m) = self._learn(words[:at]), self._merged(["\n"])[0], self._learn(words[at + 1 :])
            return np.concatenate([before, own, after]), np.concatenate([n, [len(own)], m])
        if not words:
            return self._merged([])
        units = pa.array(self.split("\n".join(words) + "\n"), pa.large_string())
        apart = pc.equal(units, "\n")
        counts = np.diff(np.r_[-1, np.flatnonzero(apart.to_numpy(zero_copy_only=False))]) - 1
        if len(counts) != len(words):
            raise ValueError("words and their pre-tokens disagree")
        return self.pieces.joined(units.filter(pc.invert(apart)), counts)

    def _even(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        marked = pa.array([t.replace(" ", "\0 ").replace("\n", "\0\n\0") for t in texts], pa.large_string())
        lists = pc.split_pattern(marked, "\0")
        return self.words.joined(lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64))

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, of texts that are cut to pre-tokens."""
        pieces = [self.split(t) for t in texts]
        return self.pieces.joined(pa.array([x for own in pieces for x in own], pa.large_string()), np.fromiter(map(len, pieces), np.int64, len(pieces)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in ``kind``."""
        out: list[bytes] = [b""] * len(texts)
        even, uneven = [], []
        for k, text in enumerate(texts):
            if text and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in UNEVEN):
                even.append(k)
            elif self.odd(text):
                out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
            elif text:
                uneven.append(k)
        size = self.kind.itemsize
        for some, make in ((even, self._even), (uneven, self._cut)):
            if some:
                ids, counts = make([texts[k] for k in some])
                held = memoryview(ids.tobytes())
                for k, end, n in zip(some, np.cumsum(counts).tolist(), counts.tolist()):
                    out[k] = bytes(held[(end - n) * size : end * size])
        return out


def _encoder(shared) -> Encoder:
    """One encoder for each worker and tokenizer."""
    kept = worker_keeps("token_files")
    if kept.get("definition") != shared.value:
        kept.update(definition=shared.value, encoder=Encoder(shared.value))
    return kept["encoder"]


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str, encode: Encoder, end_id: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    part = task.partitionId()
    store, root = local_path(folder)
    seq = 0

    def close(docs: list[int], sizes: list[int], coded_ids: list[bytes]) -> pa.RecordBatch:
        nonlocal seq
        name = f"{part:08d}-{seq:06d}{SUFFIX}"
        beside = f"{root}/_{name}-{task.taskAttemptId()}"
        ids = np.frombuffer(b"".join(coded_ids), encode.kind)
        size = 0
        with store.open_output_stream(beside) as out:
            for piece in file_parts(np.array(docs, np.int64), np.array(sizes, np.int64), ids):
                out.write(piece)
                size += len(piece)
        store.move(beside, f"{root}/{name}")
        seq += 1
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, len(docs), len(ids), size)], ["file", "n_docs", "n_tokens", "n_bytes"])

    end = np.array([end_id], encode.kind).tobytes()
    docs, sizes, held, tokens = [], [], [], 0
    for doc_ids, texts in together(batches, TOGETHER):
        for doc, found in zip(doc_ids, encode(texts)):
            docs.append(NO_ID if doc is None else doc)
            sizes.append(len(found) // len(end) + 1)
            held += (found, end)
            tokens += sizes[-1]
            if tokens >= FILE_TOKENS:
                yield close(docs, sizes, held)
                docs, sizes, held, tokens = [], [], [], 0
    if docs:
        yield close(docs, sizes, held)


def write_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Encode every whole text into files under ``folder``; one row for each file.

    The driver reads the tokenizer's file (fixed, a few MB) and ships it.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    store, root = local_path(folder)
    store.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write_batches(batches, folder, _encoder(shared), end_id)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(run, "file string, n_docs long, n_tokens long, n_bytes long"), "token-files")[0]


FOUND = ["file", "doc_id", "at", "n_tokens", "ids_crc32"]


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            doc_ids, counts, ids = read_file(content.as_py())
            ends = np.cumsum(counts)
            whole = memoryview(ids.astype("<u4").tobytes())
            checks = np.array([zlib.crc32(whole[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), counts.tolist())], np.int64)
            columns = [pa.array([path.rsplit("/", 1)[-1]] * len(counts)), pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(ends - counts), pa.array(counts), pa.array(checks)]
            yield pa.RecordBatch.from_arrays(columns, FOUND)


def read_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per document: ``(doc_id, start, n_tokens, ids_crc32)``, from the files."""
    # one row for each file, not for each document
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    content = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path", "content")
    found = content.mapInArrow(_read_batches, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(bases, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the files of ``docs`` in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = new_path(spark, "ids")
    return read_files(spark, folder, write_files(docs, folder, path, end_id))
