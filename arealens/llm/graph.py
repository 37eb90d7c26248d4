"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arealens.llm.staging import stage_table


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Written once: as a table of its own it joins through a plain exchange, which adaptive execution splits at a busy node."""
    return stage_table(edges.groupBy("a").agg(F.min("b").alias("least")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least_neighbour(both).select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    least = _least_neighbour(down)
    moved = down.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long) that has an edge; component is the least node reachable.

    Edges turn step by step towards the least neighbour until all point at the least node of their component. Every
    step is two aggregates, combined before the shuffle, and two joins that adaptive execution splits at busy nodes; their
    results are written once, so a lost executor repeats one step. Loops (a = b) are ignored.
    """
    state, edges = None, stage_table(edges.select("a", "b").filter("a != b").distinct(), "edges")
    while True:
        edges = stage_table(_small_star(_large_star(edges)), "edges")
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
