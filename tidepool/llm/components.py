"""Connected components of a link table, never gathered: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v bigint), the root being the smallest node of its component.

    Each round is a grouped minimum and a join on a node; rounds grow with the logarithm of the longest chain. Every round
    is written to the shared folder.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = Written(edges, "edges")
    state = _state(now.df)
    while state[0]:
        # Large star: every larger neighbour is tied to the smallest one (or the node itself).
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = Written(large, "large-star")
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        least = large.df.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.df.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = Written(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now.drop()
        large.drop()
        before, state, now = state, _state(small.df), small
        if state == before:
            break
    roots = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
