"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save


def _are_stars(edges: DataFrame) -> bool:
    """Every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 or ups > 0 and low = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of longs -> (node, component): for each node of a link, the smallest node that can be reached.

    Each step makes neighbours point at the smallest node near them; the edges never grow in number, and the steps
    needed grow as the logarithm of the longest path. Every step's edges are a table in the shared folder. Nothing but
    one yes or no a step comes to the driver. Links to itself and repeated links change nothing; nulls are left
    out; no links give no rows. Nodes with very many neighbours are met by joins that Spark splits when skewed.
    """
    edges = save(
        links.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")),
        "edges",
    )
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = save(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        )
        after = save(small, "small-star")
        forget(edges, large)
        edges = after
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = save(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own), "components")
    forget(edges)
    return out
