"""Connected components of a link table by alternating star contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritree.llm.common import dropped, written


def _stars(edges: DataFrame) -> bool:
    """Whether each node points to one other at most, and to none that points on: what a round leaves as it is. edges: u, v, each pair once; u = v counts as no edge."""
    ends = edges.filter("u <> v").select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("out").alias("n"), F.min("out").alias("least")).filter("n > 1 or (n = 1 and least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) of every node in links (a, b: long). Self links name lone nodes; repeated links change nothing."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    nodes = edges
    while not _stars(edges):
        # large star: each node's larger neighbours point to its least neighbour
        both = edges.filter("u <> v").unionByName(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        following = written(small, "links")
        if edges is not nodes:
            dropped(edges.sparkSession, edges.veritree_path)
        edges = following
    edges = edges.filter("u <> v")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    own = nodes.select(F.col("v").alias("node")).union(nodes.select("u")).distinct()
    return own.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
