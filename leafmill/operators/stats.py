"""Reports as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_counts(chunks: DataFrame, *by: str) -> DataFrame:
    """Counts by each column alone and in all: ``(dimension, value, n)``."""
    sets = chunks.groupingSets([[c] for c in by] + [[]], *by).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    full = (1 << len(by)) - 1
    name, value = F.lit("all"), F.lit(None).cast("string")
    for k, c in enumerate(by):
        own = F.col("_g") == full - (1 << (len(by) - 1 - k))
        name, value = F.when(own, F.lit(c)).otherwise(name), F.when(own, F.col(c).cast("string")).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


def cut(text: str, size: int = 200) -> str:
    """A text's first characters, line ends as spaces, with dots if there is more."""
    return text[:size].replace("\n", " ") + ("..." if len(text) > size else "")
