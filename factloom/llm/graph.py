"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import written


def _pull_up(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over (a, b), a > b.

    larger: every node hands its smallest neighbour to its larger neighbours; otherwise every node
    hands its smallest neighbour to itself and its smaller neighbours. Only minima are shuffled
    through an aggregate, so a node with millions of neighbours never meets one task.
    """
    if larger:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    edges: columns a and b of one integral type; loops, repeats and nulls are ignored. Alternates
    large-star and small-star steps, which need a number of rounds logarithmic in the number of
    nodes for any shape, and writes each round to the shared folder.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
        now = written(_pull_up(_pull_up(now, larger=True), larger=False), "edges")
