"""Connected components of an edge table: alternating large-star and small-star steps.

Each step joins every edge with the smallest neighbour of its ends and keeps only edges towards it, until
nothing changes; a star takes one step, a path of n nodes about log n. Only one row (a count and a sum of
hashes) comes to the driver per round. A node with very many edges is pre-aggregated before its shuffle
and its join can be split by adaptive execution. Every round is written to the shared folder, so a lost
executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v). Large star: both directions, neighbours above u move to u's minimum; small star: those below."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        e = cut(_star(_star(e, large=True), large=False))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
