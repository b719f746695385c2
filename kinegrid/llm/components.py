"""Distributed connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined on the map side) and an equi-join; a hub with a third of all
edges is a skewed join side that adaptive execution splits, never one group in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinegrid.llm.common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, checkpointed, with their number and a sum of their hashes, which are taken on the way."""
    seen = Observation()
    edges = cut_lineage(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
    return edges, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, component) for every node of an edge between different nodes; component: its least node.

    Edges with a null end and loops are dropped; repeated edges count once; no edges give no rows.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull())
    edges, state = _settled(edges.where(edges[2]).where("u <> v").select("u", "v").distinct())
    for _ in range(rounds if state[0] else 0):
        last = state
        edges, state = _settled(_small_star(_large_star(edges)))
        if state == last:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
