"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouping import apart
from .session import cut


def _star(edges: DataFrame) -> DataFrame:
    """Every node with each neighbour and the least of itself and its neighbours."""
    least = apart(edges, ["u"], F.min("v").alias("m")).withColumn("m", F.least("m", "u"))  # a hub's links can be split
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all ends of ``links`` (u, v: long); component is the least node reachable.

    Each round is checkpointed; rounds grow with the logarithm of the longest
    path. Nothing is collected but a count and a checksum of the links.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = cut(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        large = _star(both(edges)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is the least of its own neighbours keeps a link to itself out of the result
        large = large.where("u != v").distinct()
        star = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u != v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
