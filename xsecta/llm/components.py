"""Connected components of link tables by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links(a, b): component is the smallest node of each connected part.

    Each round hangs every node's larger neighbours on its smallest one (large star), then a node's smaller neighbours
    and itself on the smallest (small star). Both are a minimum per node and a join, so no node's neighbours are ever
    collected; rounds go on until one changes nothing, and their number grows with the logarithm of the graph's diameter.
    """
    edges = saved(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").select(F.col("b").alias("x"), F.col("low").alias("b"), "a")
        new = small.select(F.col("x").alias("a"), "b").unionByName(small.select("a", "b")).filter("a != b").distinct()
        new = saved(new)
        same = new.count() == edges.count() and new.exceptAll(edges).isEmpty()
        forget(edges)
        edges = new
        if same:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.join(edges.select(F.col("a").alias("node")), "node", "left_anti")).groupBy("node").agg(F.min("component").alias("component"))
