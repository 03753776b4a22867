"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``) that is not the smallest of its component.

    Each round hangs the larger neighbours of a node, then the smaller ones, on the smallest node it
    sees, until every node hangs on one root; rounds grow with the logarithm of the longest path.
    Nothing but the answer to that question reaches the driver; lineage is cut each round.
    """
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    while True:
        both = stars.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
            .filter("u != v").distinct()
        )
        stars = cut_lineage(small)
        ends = stars.select(F.inline(F.array(
            F.struct(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
            F.struct(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")),
        )))
        open_ends = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 OR hangs = 1 AND holds = 1")
        if open_ends.isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
