"""Connected components of verified links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS = 50


def _stars(edges: DataFrame) -> bool:
    """Every node points at one other, which points at none."""
    twice = edges.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").select("v")
    chained = edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").select("v")
    return twice.union(chained).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Least node reachable from each linked node: ``node, component``.

    ``links(a, b)`` are pairs of long ids, in any order.  Each round points
    every larger neighbour of a node at the least node next to it, then every
    smaller one; the edges end as stars around the least nodes after a number
    of rounds that grows with the logarithm of the longest path.  Edges stay
    in Spark; only whether they are stars comes to the driver.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    e = written(e, "edges")
    for _ in range(ROUNDS):
        if _stars(e):
            break
        # larger neighbours to the least of all neighbours
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).union(e.select(F.col("u"), F.col("v")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = (both.filter("y > x").join(least, "x").filter("y <> m")
                 .select(F.col("y").alias("v"), F.col("m").alias("u")).distinct())
        large = written(large, "large")
        # smaller neighbours, and the node itself, to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(least, "v").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .union(least.select("v", F.col("m").alias("u"))).distinct())
        e = written(small, "small")
    else:
        raise RuntimeError("components did not settle")
    ends = e.groupBy("v").agg(F.min("u").alias("component"))
    own = ends.select(F.col("component").alias("v"), "component").distinct()
    return ends.union(own).groupBy(F.col("v").alias("node")).agg(F.min("component").alias("component"))
