"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import forget, written


def _are_stars(edges: DataFrame) -> bool:
    """Whether of the links (u, v), u > v, no node is the upper end of two, or of one and the lower end of another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up + low > 1 AND up > 0").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b); component is the smallest node reachable.

    Each round is two groupings with map-side minima and two joins; the links of a round are written to
    the shared folder, and the driver sees only whether they are stars by then, so that no round is made in vain:
    the driver keeps the plan and the small tables of each."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, written(small, "components")
        forget(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
