"""Pluggable models: sentence encoders and entity extractors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities
from ..packs import LanguagePack, Settings
from ..shared import written
from .asking import Asking, with_answers

#: texts -> one vector each; made once for each worker.
Encoder = Callable[[list[str]], np.ndarray]
#: a prompt's text -> the model's answer.
Extractor = Callable[[str], str]

PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "


class HashingEncoder:
    """A deterministic encoder of hashed words, for tests and as a baseline."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for k, text in enumerate(texts):
            for word in text.lower().split():
                code = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[k, code % self.size] += 1 if code >> 60 & 1 else -1
        return out


class SentenceEncoder:
    """A sentence-transformers model, if that library is installed."""

    def __init__(self, name: str):
        from sentence_transformers import SentenceTransformer

        self.model = SentenceTransformer(name)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.model.encode(texts, batch_size=32)


_made: dict = {}


def embedded(rows: DataFrame, make: Callable[[], Encoder], text: str = "text", prefix: str = PASSAGE_PREFIX, batch: int = 32) -> DataFrame:
    """Adds ``embedding``: the prefixed text's vector, of length one.

    A worker makes the encoder once and keeps it for later tasks, known by the
    pickled bytes of ``make``: equal closures share it, others never do.
    """
    from pyspark import cloudpickle

    key = hashlib.blake2b(cloudpickle.dumps(make)).digest()

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _made:
            _made.clear()  # one model in memory at a time
            _made[key] = make()
        encoder = _made[key]
        for texts in batches:
            parts = [np.asarray(encoder(texts.iloc[k : k + batch].tolist()), np.float32) for k in range(0, len(texts), batch)]
            vectors = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(vectors))

    udf = F.pandas_udf(encode, "array<float>")
    return rows.withColumn("embedding", udf(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))))


#: Our own words for the extractor; ``{types}`` and ``{text}`` are filled in.
SYSTEM_PROMPT = """You read Serbian medical text and list the entities that it names.
Answer with one JSON object and nothing else. Every key must be present, with an empty list if the text names none.
Write every value in Serbian, in Latin script and lower case; translate English terms and transliterate Cyrillic ones.
Give whole terms only, each under the one key that it belongs to: a disease is no symptom, a test is no measure, an amount with its unit is a dose.
Leave out grades of evidence and of recommendation. Add nothing that the text does not say."""
USER_PROMPT = """Keys of the object:
{types}

Text:
---
{text}
---
JSON:"""
TEMPERATURE = 0.1
OUTPUT_TOKENS = 2500


def prompt(text: str, types: list[str]) -> str:
    """What the extractor is asked about a text; braces in it stay."""
    return USER_PROMPT.replace("{types}", "\n".join(f"- {x}" for x in types)).replace("{text}", text)


class ChatClient:
    """An extractor behind a chat-completions service (``POST url/chat/completions``)."""

    def __init__(self, url: str, model: str, types: list[str], key: str = "none", seconds: float = 600):
        self.url, self.model, self.types, self.key, self.seconds = url.rstrip("/"), model, types, key, seconds

    def _ask(self, path: str, body: dict | None = None) -> dict:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        request = Request(self.url + path, json.dumps(body).encode() if body else None, headers)
        with urlopen(request, timeout=self.seconds) as answer:  # noqa: S310  the caller's own service
            return json.loads(answer.read())

    def reachable(self) -> bool:
        """Whether the service answers at all."""
        try:
            return "data" in self._ask("/models")
        except (OSError, ValueError):
            return False

    def __call__(self, text: str) -> str:
        said = [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": prompt(text, self.types)}]
        found = self._ask("/chat/completions", {"model": self.model, "messages": said, "temperature": TEMPERATURE, "max_tokens": OUTPUT_TOKENS})
        return found["choices"][0]["message"]["content"].strip()


#: What became of a chunk.
KEPT, NONE, UNREADABLE, FAILED = "kept", "no entity", "unreadable", "failed"
RECORD = ["chunk_id", "source", "pdf_page", "section_ids", "section_path", "chunk_type", "entities"]


def extraction(chunks: DataFrame, make: Callable[[], Extractor], pack: LanguagePack = LanguagePack(), settings: Settings = Settings(), how: Asking = Asking()) -> DataFrame:
    """Every chunk with ``entities``, ``status``, ``failure`` and ``attempts``; one call a chunk.

    ``status`` is ``kept`` (any entity), ``no entity``, ``unreadable`` (an answer
    without a JSON object) or ``failed`` (the service, with the reason in
    ``failure``). Each action on the result asks anew, so write it first.
    """
    given = chunks.select(*RECORD[:-1], F.substring("text", 1, settings.extractor_chars).alias("_text"))
    told = with_answers(given, make, "_text", how).withColumn("_parsed", entities.repaired_json(F.col("answer")))
    told = told.withColumn("entities", entities.valid_entities(F.col("_parsed"), pack.entity_types))
    status = F.when(F.col("failure").isNotNull(), F.lit(FAILED)).when(F.col("_parsed").isNull(), F.lit(UNREADABLE)).when(entities.has_entity(F.col("entities")), F.lit(KEPT)).otherwise(F.lit(NONE))
    return told.select(*RECORD, status.alias("status"), "failure", "attempts")


def records(told: DataFrame) -> DataFrame:
    """The entity records of an extraction."""
    return told.where(F.col("status") == KEPT).select(*RECORD)


def extracted(chunks: DataFrame, make: Callable[[], Extractor], pack: LanguagePack = LanguagePack(), settings: Settings = Settings(), how: Asking = Asking()) -> DataFrame:
    """Chunks -> entity records with any entity; an extractor's failure counts as none.

    The answers are written to the shared folder, where they stay, so that a chunk
    is asked about once however often the records are read.
    """
    told, _ = written(extraction(chunks, make, pack, settings, how), "extraction")
    return records(told)
