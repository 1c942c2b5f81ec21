"""Connected components of an edge table, by alternating large-star and small-star steps (no edge leaves the cluster)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import scratch


def _large_star(edges: DataFrame, name: str) -> DataFrame:
    """Every neighbour larger than a node hangs on the node's smallest neighbour (or the node itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # a table of its own, so that both sides of the join are shuffled for it and a hub's edges can be split at run time
    low = scratch(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), name)
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, name: str) -> DataFrame:
    """Every neighbour smaller than a node, and the node, hang on its smallest neighbour.  Edges run from large to small."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = scratch(down.groupBy("u").agg(F.min("v").alias("low")), name)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).where("u != v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none: then each star is a component."""
    if not edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    centres = edges.select(F.col("v").alias("u")).distinct()
    return edges.join(centres, "u", "left_semi").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node of the component, for every node of an edge (u, v: long)."""
    now = scratch(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not _stars(now):
        now = scratch(_small_star(scratch(_large_star(now, name), name), name), name)
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())
