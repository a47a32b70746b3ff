"""Order-dependent operators as windows: runs, segments, islands, as-of rows.

Each takes a DataFrame, the columns that group it and the columns that order a
group. A group is a document or a user's events, never a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def ordered(group: list[str], order: list[str]):
    return Window.partitionBy(*group).orderBy(*order)


def next_value(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The value of the nearest later row that has one."""
    later = ordered(group, order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.first(value, ignorenulls=True).over(later))


def segments(df: DataFrame, group: list[str], order: list[str], start: Column, end: Column, name: str) -> DataFrame:
    """The ordinal (from 1) of the segment that a row is in, or null outside.

    A start row opens a segment and closes the one before; an end row closes it
    and is outside.
    """
    w = ordered(group, order)
    event = F.when(start, F.lit(1)).when(end, F.lit(0))
    counted = df.withColumn("_state", F.last(event, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.sum(F.when(start, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn(name, F.when(F.col("_state") == 1, nth.cast("int"))).drop("_state")


def islands(df: DataFrame, group: list[str], order: list[str], member: Column, name: str, least: int = 1) -> DataFrame:
    """The ordinal (from 1) of the maximal run of member rows, runs of at least ``least``."""
    w = ordered(group, order)
    found = df.withColumn("_in", F.coalesce(member, F.lit(False)))
    found = found.withColumn("_gap", F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*group, "_gap", "_in")
    found = found.withColumn("_size", F.count("*").over(run)).withColumn("_kept", F.col("_in") & (F.col("_size") >= least))
    first = F.col("_kept") & ~F.coalesce(F.lag("_kept").over(w), F.lit(False))
    nth = F.sum(F.when(first, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("_first", first).withColumn(name, F.when(F.col("_kept"), nth.cast("int"))).drop("_in", "_gap", "_size", "_kept", "_first")


def leads_before(df: DataFrame, group: list[str], order: list[str], wanted: Column, stop: Column, rows: int, name: str) -> DataFrame:
    """Whether a wanted row comes within the next rows, and before any stop row."""
    w = ordered(group, order)
    ahead = w.rowsBetween(1, rows)
    numbered = df.withColumn("_at", F.row_number().over(w)).withColumn("_want", F.when(wanted, F.col("_at"))).withColumn("_stop", F.when(stop, F.col("_at")))
    first_want, first_stop = F.min("_want").over(ahead), F.min("_stop").over(ahead)
    found = first_want.isNotNull() & (first_stop.isNull() | (first_want < first_stop))
    return numbered.withColumn(name, found).drop("_at", "_want", "_stop")


def first_run(df: DataFrame, group: list[str], order: list[Column], start: Column, go_on: Column) -> DataFrame:
    """The first contiguous run: from the first start row while ``go_on`` holds."""
    w = Window.partitionBy(*group).orderBy(*order)
    whole = Window.partitionBy(*group)
    numbered = df.withColumn("_at", F.row_number().over(w)).withColumn("_start", start).withColumn("_on", go_on)
    numbered = numbered.withColumn("_from", F.min(F.when(F.col("_start"), F.col("_at"))).over(whole))
    numbered = numbered.withColumn("_to", F.min(F.when((F.col("_at") > F.col("_from")) & ~F.col("_on"), F.col("_at"))).over(whole))
    kept = numbered.where((F.col("_at") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("_at") < F.col("_to"))))
    return kept.drop("_at", "_start", "_on", "_from", "_to")


def as_of(left: DataFrame, right: DataFrame, group: list[str], at: str, order: str, value: str, name: str) -> DataFrame:
    """For each left row the value of the last right row at or before it.

    Both sides are merged and scanned once per group; of right rows with equal
    ``at`` the one of the largest ``order`` counts, also for left rows there.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_order", F.lit(None).cast("long")).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*group, at, F.lit(0).alias("_side"), F.col(order).cast("long").alias("_order"), F.col(value).alias("_value"), F.lit(True).alias("_there"))
    both = a.withColumn("_there", F.lit(None).cast("boolean")).unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*group).orderBy(at, "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_there"), F.struct("_value")), ignorenulls=True).over(w)
    return both.withColumn(name, last["_value"]).where("_side = 1").select(*left.columns, name)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each row's place (from 1) in the whole order, without a task that holds all rows.

    Rows are dealt out by ranges and written; what stands in earlier ranges is
    added to the place within the own one.
    """
    rows, _ = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = rows.groupBy("_range").agg(F.count("*").alias("_rows"))
    # one row for each range
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_within", within).join(before.select("_range", "_before"), "_range").withColumn(name, (F.col("_before") + F.col("_within")).cast("int")).drop("_range", "_within", "_before")
