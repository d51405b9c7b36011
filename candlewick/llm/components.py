"""Connected components of an edge table by alternating star steps.

Large star: every node hands its larger neighbours to its smallest
neighbour.  Small star: it does so with its smaller neighbours.  Both are one
groupBy and one join on the node; the loop ends when the edges no longer
change.  Edges stay in Spark; only a count and a checksum reach the driver.
A hub's edges are spread by the join (adaptive skew handling), never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
    return row[0], row[1]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b); the
    component is its smallest node."""
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = _state(edges)
    for _ in range(max_rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("x"), F.col("b").alias("y")).where("x <> y").distinct()
        # x < y: y's smaller neighbours go to the smallest of them
        small = large.groupBy("y").agg(F.min("x").alias("m"))
        linked = large.join(small, "y")
        edges = cut(linked.select(F.col("m").alias("a"), F.col("x").alias("b"))
                    .union(linked.select(F.col("m").alias("a"), F.col("y").alias("b"))).where("a <> b").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # a star: every node but the centre has one smaller neighbour, the component
    return (edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
            .union(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct())
