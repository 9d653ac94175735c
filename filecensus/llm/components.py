"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecensus.llm.shared import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Hang the larger (or smaller) neighbours of each vertex on its least neighbour."""
    if not larger:
        pairs = pairs.where("b < a")
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    hung = pairs.join(least, "a")
    hung = hung.where("b > a") if larger else hung
    out = hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of the edges (a, b); a component is its least vertex.

    Only edges move between rounds, each round is written to the shared folder, and the
    driver sees two numbers per round.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    while True:
        large = _star(_both(edges), True)
        edges = stored(_star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = edges.select(F.col("b").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(roots)
