"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node of its component, for all nodes of `edges` (u, v).

    Rounds of joins and grouped minima; each round is checkpointed, and ends nothing but the list itself on disk. The
    number of rounds grows with the logarithm of the longest path. An empty list gives no rows.

    The minima are stored before they are joined: then neither side of the join comes straight from a grouping, and Spark
    can split the partition of a node with very many links.
    """
    tight = lambda e: common.checkpointed(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = tight(edges)
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tight(large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))))
        least = common.checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = tight(small.unionByName(least.select("u", F.col("m").alias("v"))))
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(edges.select("v").distinct().join(roots.select(F.col("u").alias("v")), "v", "left_anti").select(F.col("v").alias("node"), F.col("v").alias("root")))
