"""Asking a service about every row: once a row, some requests at a time, with retries.

The call stands in ``mapInArrow``, which Spark neither moves nor copies, so a row
costs one call wherever its answer is used afterwards; a table that is read more
than once has to be written first (``models.extracted`` does). A task that is run
again asks again. A row whose service fails stays, with the reason.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.error import HTTPError

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Answers of a service that may be otherwise a little later.
PASSING = {408, 425, 429, 500, 502, 503, 504}
#: Longest reason that is kept.
REASON_CHARS = 300


class Passing(Exception):
    """An extractor raises it for a failure that another attempt may not have."""


@dataclass(frozen=True)
class Asking:
    """How a worker asks; an extractor must stand calls from ``in_flight`` threads."""

    #: Requests that one worker has open at once.
    in_flight: int = 4
    attempts: int = 4
    #: Seconds before the second attempt; doubled before each further one.
    wait: float = 1.0
    most_wait: float = 60.0


def passes(error: Exception) -> bool:
    """Whether another attempt may help: overload and broken connections, not refusals."""
    if isinstance(error, HTTPError):
        return error.code in PASSING
    return isinstance(error, (OSError, Passing))


def wished_wait(error: Exception) -> float | None:
    """The seconds that the service itself names."""
    said = error.headers.get("Retry-After") if isinstance(error, HTTPError) and error.headers else None
    return float(said) if said and said.strip().isdigit() else None


def answered(client: Callable[[str], str], text: str, how: Asking, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str | None]:
    """(answer, attempts, reason of failure) for one text."""
    for attempt in range(1, how.attempts + 1):
        try:
            return client(text), attempt, None
        except Exception as error:  # noqa: BLE001  the service's own errors
            if attempt == how.attempts or not passes(error):
                return None, attempt, f"{type(error).__name__}: {error}"[:REASON_CHARS]
            wished = wished_wait(error)
            sleep(min(how.most_wait, how.wait * 2 ** (attempt - 1) if wished is None else wished))
    raise ValueError("at least one attempt is needed")


def with_answers(rows: DataFrame, make: Callable[[], Callable[[str], str]], text: str, how: Asking = Asking()) -> DataFrame:
    """Adds ``answer``, ``attempts`` and ``failure`` to every row; a null text is asked as an empty one."""
    asked = rows.withColumn("_asked", F.coalesce(F.col(text).cast("string"), F.lit("")))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        with ThreadPoolExecutor(how.in_flight) as pool:
            for batch in batches:
                # few rows at a time, so that what is waiting is bounded and answers leave early
                for at in range(0, len(batch), 16 * how.in_flight):
                    part = batch.slice(at, 16 * how.in_flight)
                    texts = part.column(part.schema.get_field_index("_asked")).to_pylist()
                    found = list(pool.map(lambda x: answered(client, x, how), texts))
                    told = [pa.array(x, kind) for x, kind in zip(zip(*found), (pa.string(), pa.int32(), pa.string()))]
                    kept = [(f, c) for f, c in zip(part.schema, part.columns) if f.name != "_asked"]
                    yield pa.RecordBatch.from_arrays([*[c for _, c in kept], *told], [*[f.name for f, _ in kept], "answer", "attempts", "failure"])

    added = F.struct(F.lit("").alias("answer"), F.lit(0).alias("attempts"), F.lit("").alias("failure"))
    schema = rows.limit(0).withColumns({f"{c}": added[c] for c in ("answer", "attempts", "failure")}).schema
    for field in schema.fields[-3:]:
        field.nullable = True
    return asked.mapInArrow(ask, schema)
