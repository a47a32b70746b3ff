"""Connected components of an edge table, by alternating star contractions.

Each round is two group-bys with map-side minima and two joins on the node;
rounds are cut by tables in the shared folder, so a lost executor costs one
round. Only a round's edge count and checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

MAX_ROUNDS = 60


def components(edges: DataFrame, name: str = "components") -> tuple[DataFrame, list[str]]:
    """``edges(a, b)`` -> ``(node, root)``, root the least node of a component.

    Every node of an edge appears once; loops and nulls are left out, repeated
    edges count once. Also returns the tables that the result reads.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = written(now, f"{name}-0")
    mark = _mark(now)
    for k in range(1, MAX_ROUNDS):
        if not mark[0]:
            break
        grown, grown_path = written(_small_star(_large_star(now)), f"{name}-{k}")
        drop(spark, path)
        path, before, now = grown_path, mark, grown
        mark = _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), [path]


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return tied.unionByName(own).where("a <> b").distinct()
