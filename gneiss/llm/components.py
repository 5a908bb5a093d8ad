"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.session import materialise


def components(links: DataFrame) -> DataFrame:
    """node, root: each node of ``links`` (u, v) with the smallest node it is connected to.

    Each round links a node's larger neighbours, then its smaller ones, to the smallest; the number of rounds grows with the
    logarithm of the longest path. Neighbours are never gathered: the smallest one is an aggregate that is joined back.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "small-star")
        # done when every node hangs on one root and no root hangs on another
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("roots")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("hangs").alias("h"), F.max("roots").alias("r")).filter("h > 1 or h > 0 and r > 0").isEmpty():
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
