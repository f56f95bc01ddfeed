"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.storage import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or smaller) neighbours, and for small stars itself, to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    kept = both.filter(F.col("b") > F.col("a")) if large else both
    out = kept.join(least, "a").select(F.col("b").alias("x"), F.col("least").alias("y"))
    if not large:
        out = out.unionByName(least.select(F.col("a").alias("x"), F.col("least").alias("y")))
    return out.filter(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(links: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); a component's name is its least node.

    Each step is a few joins and sums over the edges, which never leave the executors; the steps end when none
    changes an edge. Loops and repeated links don't matter; a node without a link has no row.
    """
    edges = materialize(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_steps):
        edges = materialize(_star(_star(edges, True), False))
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30))).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
