"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouping and a join of edges (two identifiers each); nothing is
collected.  Each round's edges are written to the shared folder, which cuts
lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.sources.work import Work


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    joined = down.join(least, F.col("u") == F.col("w"))
    return joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("w").alias("a"), F.col("m").alias("b")))


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node points to one other, which points nowhere."""
    ends = edges.select(F.col("a").alias("x")).union(edges.select("b").distinct())
    return ends.groupBy("x").count().where("count > 1").isEmpty()


def components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """(node, component) of every node but the smallest of each component, which names it.  edges: longs a and b; loops and repeats are allowed."""
    current, turn = edges.where("a <> b").select("a", "b").distinct(), 0
    while True:
        current = work.table(_small_star(_large_star(current).distinct()).distinct(), f"{name}-stars{turn}")
        if _is_settled(current):
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        if turn:
            work.drop(f"{name}-stars{turn - 1}")
        turn += 1
