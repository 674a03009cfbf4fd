"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from varve.session import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the greater (or not greater) neighbours of each node to the least node at hand.

    The least neighbour of a node is an aggregate that is joined back: no node's neighbours are
    ever gathered in one row or task, so a hub with any number of them is safe.
    """
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = around.join(least, "u")
    if large:
        tied = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        # the node itself is one of its lesser neighbourhood
        tied = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return tied.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) of every node on an edge (a, b); a component is named by its least node.

    Edges keep nothing but their ends; loops and repeats are ignored. Every round is written to the
    checkpoint folder. Rounds needed grow with the logarithm of the longest chain.
    """
    now = checkpointed(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(limit):
        seen = Observation()
        mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
        now = checkpointed(_star(_star(now, True), False).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(mixed).alias("h")))
        state = (seen.get["n"], seen.get["h"])
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
    raise RuntimeError("components did not settle")
