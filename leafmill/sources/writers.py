"""Sinks: tables by source, JSON lines, JSON documents, indexes, resumed appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import drop, table_if_there


def write_by_source(df: DataFrame, path: str) -> None:
    """One folder per source, overwritten."""
    df.write.mode("overwrite").partitionBy("source").parquet(path)


def export_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, one folder per source, text as it is."""
    df.write.mode("overwrite").partitionBy("source").option("ignoreNullFields", "false").json(path)


def export_documents(df: DataFrame, path: str, key: str = "source") -> None:
    """One JSON document a line for each source, its rows nested, in the order of their columns."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias("rows"))
    rows.select(F.to_json(F.struct(key, "rows"), {"pretty": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_index(rows: DataFrame, path: str, order: list[str], model: str, prefix: str) -> None:
    """Rows with ``embedding_id`` 0..n-1 in the given order, and the index's facts.

    The ordinal is a two-step count: rows per range partition, then within it, so
    no task holds all rows.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged.write.mode("overwrite").parquet(f"{path}/staged")
    staged = rows.sparkSession.read.parquet(f"{path}/staged")
    counts = staged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    numbered = staged.withColumn("_k", within).join(counts.withColumn("_before", before), "_p")
    numbered.withColumn("embedding_id", F.col("_before") + F.col("_k")).drop("_p", "_n", "_k", "_before").write.mode("overwrite").parquet(f"{path}/rows")
    size = F.max(F.size("embedding"))
    meta = staged.agg(F.count("*").alias("n_rows"), size.alias("dimension")).select(F.lit(model).alias("model_name"), "dimension", "n_rows", F.lit("flat inner product").alias("index_type"), F.lit(True).alias("normalized"), F.lit(prefix).alias("prefix"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    meta.write.mode("overwrite").json(f"{path}/meta")


def pending(rows: DataFrame, done: DataFrame | None, key: str = "chunk_id") -> DataFrame:
    """Rows not processed yet, by key."""
    return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")


def append_resumed(rows: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, key: str = "chunk_id") -> None:
    """Process what ``path`` lacks and append it, as one job with one commit.

    For work that is quickly done again; ``run_resumed`` keeps what a broken run has done.
    """
    process(pending(rows, table_if_there(rows.sparkSession, path), key)).write.mode("append").parquet(path)


WAVE = "wave int, bucket int, n_keys bigint, n_rows bigint"


def finished(spark: SparkSession, path: str, table: str = "rows", wave: bool = False) -> DataFrame | None:
    """What the finished buckets of ``run_resumed`` hold, or None before the first; ``wave`` keeps the run's number."""
    marks, found = table_if_there(spark, f"{path}/marks", WAVE), table_if_there(spark, f"{path}/{table}")
    if marks is None or found is None:
        return None
    return found.join(marks.select("wave", "bucket"), ["wave", "bucket"], "left_semi").drop("bucket", *([] if wave else ["wave"]))


def run_resumed(rows: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, key: str = "chunk_id", buckets: int = 32, again: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Process the rows that earlier runs have not, bucket by bucket; gives all that is finished.

    A run first stages the rows whose keys no finished bucket has, dealt to
    ``buckets`` by a hash of the key (or by ``bucket``), and then processes one
    bucket after the other. What a bucket gives is written to a folder of its own,
    its keys beside it, and last its mark: a run that breaks off loses the bucket
    it was in, and a folder without a mark is not read. The next run starts from
    there; rows that have come meanwhile are in it. Rows of the result for which
    ``again`` holds go to ``path/failed`` instead, and their keys are processed
    again by the next run.

    Several rows of one key are processed together. A null key is processed by
    every run, as nothing tells whether it has been. One run at a time may write.
    """
    spark = rows.sparkSession
    marks = table_if_there(spark, f"{path}/marks", WAVE)
    wave = 1 + (marks.agg(F.coalesce(F.max("wave"), F.lit(0))).first()[0] if marks is not None else 0)
    number = F.coalesce(bucket if bucket is not None else F.pmod(F.xxhash64(key), F.lit(buckets)), F.lit(0)).cast("int")
    waiting = pending(rows, finished(spark, path, "keys"), key).withColumn("_bucket", number)
    # large buckets in several files, small ones in one
    waiting.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/staged")
    staged = spark.read.schema(waiting.schema).parquet(f"{path}/staged")
    for b in sorted(r[0] for r in staged.select("_bucket").distinct().collect()):
        _finish_bucket(staged.where(F.col("_bucket") == b).drop("_bucket"), process, path, key, f"wave={wave}/bucket={b}", again)
    found = finished(spark, path)
    return found if found is not None else process(staged.drop("_bucket").limit(0))


def _finish_bucket(rows: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, key: str, place: str, again: Column | None) -> None:
    spark = rows.sparkSession
    made = f"{path}/rows/{place}"
    if again is not None:
        made = f"{path}/made/{place}"
    process(rows).write.mode("overwrite").parquet(made)
    out, keys = spark.read.parquet(made), rows.select(key).where(F.col(key).isNotNull()).distinct()
    if again is not None:
        lost = F.coalesce(again, F.lit(False))
        out.where(~lost).write.mode("overwrite").parquet(f"{path}/rows/{place}")
        out.where(lost).write.mode("overwrite").parquet(f"{path}/failed/{place}")
        keys = keys.join(out.where(lost).select(key), key, "left_anti")
    keys.write.mode("overwrite").parquet(f"{path}/keys/{place}")
    if again is not None:
        drop(spark, made)
    n_keys, n_rows = (spark.read.parquet(f"{path}/{name}/{place}").count() for name in ("keys", "rows"))
    spark.range(1).select(F.lit(n_keys).cast("bigint").alias("n_keys"), F.lit(n_rows).cast("bigint").alias("n_rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/{place}")


def failed(spark: SparkSession, path: str, key: str = "chunk_id") -> DataFrame | None:
    """Rows that are to be processed again, as the last run left them: failed in a finished bucket, and not done since."""
    lost, done = finished(spark, path, "failed", wave=True), finished(spark, path, "keys")
    if lost is None:
        return None
    last = lost.groupBy(key).agg(F.max("wave").alias("wave"))
    return pending(lost.join(last, [key, "wave"], "left_semi").drop("wave"), done, key)
