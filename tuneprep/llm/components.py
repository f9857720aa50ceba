"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.storage import materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every node of (u, v) has one link down, to a node that has none."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    counts = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return counts.where("down > 1 or down = 1 and up = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    ``links`` has columns a and b. Each step replaces links by links to the smallest neighbour; it
    ends when every node is linked to its component's smallest one, which for links that earlier
    components gave is before the first step. A node's neighbours are
    never gathered: their minimum is combined before the shuffle, then joined back, and a
    node with very many of them is a skewed join, which adaptive execution splits.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.where("u <> v").distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components of further links (a, b) on top of earlier components."""
    return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
