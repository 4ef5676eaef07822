"""Connected components of a graph given as links, for links of any number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.session import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node it reaches, for every node of a link.

    Links with a null end are ignored; direction, repetition and self-links do not matter.
    Large-star and small-star steps alternate: every node hangs its larger neighbours, then
    its smaller ones, onto the smallest neighbour, until each component is a star. A step
    is an aggregation with map-side combining and a join, which adaptive execution splits
    where a node has very many links. The links after each step are stored.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    alone = edges.where("u = v").select("u", "v")
    edges = stored(edges.where("u <> v").distinct(), "links")
    while not _are_stars(edges):
        edges = stored(_small_star(_large_star(edges)), "stars")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    lone = alone.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return (
        leaves.unionAll(roots).unionAll(lone).groupBy("node").agg(F.min("component").alias("component"))
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one link, and no smaller end is a larger one elsewhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("larger")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("larger"))
    )
    roles = ends.groupBy("node").agg(F.sum("larger").alias("as_u"), F.count("*").alias("all"))
    return roles.where("as_u > 1 OR (as_u > 0 AND all > as_u)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours become linked to its smallest neighbour or itself."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, become linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
