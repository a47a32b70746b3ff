"""Documents put together from a stream of pages.

Pages of a document arrive in any order, some twice, some late, and some never.
The state of a document is its pages one by one, so a page that arrives reads and
writes itself alone. A document is given out when all its pages are there, or
when event time has gone on for ``wait`` since its last page without the rest; a
page that comes, or comes changed, after that gives it out again as its next
version. State is forgotten ``keep`` after the last page.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A page as it arrives; ``n_pages`` is the document's number of pages, null if it is not known.
PAGE = "source string, page int, text string, n_pages int, seen timestamp"
DOCUMENT = "source string, version int, complete boolean, n_pages int, text string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Assembler(StatefulProcessor):
    def __init__(self, wait: timedelta, keep: timedelta):
        self.wait, self.keep = (int(x.total_seconds() * 1000) for x in (wait, keep))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "text string")
        # pages in all, version given out last, the time of the last page, whether something is new
        self.facts = handle.getValueState("facts", "n_pages int, version int, last bigint, fresh boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n_pages, version, last, fresh = self.facts.get() if self.facts.exists() else (None, 0, None, False)
        for part in rows:
            for r in part.sort_values(["page", "seen", "text"], na_position="first").itertuples(index=False):
                at = int(r.seen.timestamp() * 1000)
                last = at if last is None else max(last, at)
                if not pd.isna(r.n_pages):
                    n_pages = max(n_pages or 0, int(r.n_pages))
                if pd.isna(r.page):
                    continue
                page, text = (int(r.page),), (r.text or "",)
                # tuples of the state's columns
                if not self.pages.containsKey(page) or tuple(self.pages.getValue(page)) != text:
                    self.pages.updateValue(page, text)
                    fresh = True
        if last is None:
            return
        held = sum(1 for _ in self.pages.keys())
        complete = n_pages is not None and held >= n_pages
        if fresh and complete:
            version, fresh = version + 1, False
            yield self._document(key, version, True)
        self.facts.update((n_pages, version, last, fresh))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + (self.wait if fresh else self.keep))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n_pages, version, last, fresh = self.facts.get()
        if fresh:
            yield self._document(key, version + 1, False)
            self.facts.update((n_pages, version + 1, last, False))
            self.handle.registerTimer(last + max(self.keep, self.wait + 1))
        else:
            self.pages.clear()
            self.facts.clear()

    def _document(self, key: Any, version: int, complete: bool) -> pd.DataFrame:
        held = sorted((page[0], text[0]) for page, text in self.pages.iterator())
        return pd.DataFrame({"source": [key[0]], "version": [version], "complete": [complete], "n_pages": [len(held)], "text": ["\n".join(text for _, text in held)]})

    def close(self) -> None:
        pass


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Pages from a folder of Parquet files that grows."""
    return spark.readStream.schema(PAGE).option("maxFileAge", "36500d").parquet(folder)


def assembled(pages: DataFrame, wait: timedelta = timedelta(hours=1), keep: timedelta = timedelta(days=1), lateness: str = "10 minutes") -> DataFrame:
    """Pages as they arrive -> documents as they are complete, or as far as they came.

    Rows without source are left out; a page number null only tells ``n_pages`` and
    the time. Of a page that comes twice with two texts in one batch the later one
    counts. The session has to keep state in ``PROVIDER``.
    """
    known = pages.where("source is not null and seen is not null").withWatermark("seen", lateness)
    return known.groupBy("source").transformWithStateInPandas(statefulProcessor=_Assembler(wait, keep), outputStructType=DOCUMENT, outputMode="Append", timeMode="EventTime")


def latest(documents: DataFrame) -> DataFrame:
    """Each document's last version."""
    best = documents.groupBy("source").agg(F.max(F.struct("version", "complete", "n_pages", "text")).alias("_d"))
    return best.select("source", "_d.*")
