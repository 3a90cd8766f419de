"""Connected components of a table of links, by alternating star rounds in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import stage


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _towards_least(pairs: DataFrame) -> DataFrame:
    """For rows (u, v): v and u's least neighbour or u itself, whichever is less."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; a component is named by its least node.

    Large-star and small-star rounds alternate until no edge changes; each is one aggregate and one
    join, so a hub's links are never gathered. Every round is written to the staging folder. The
    number of rounds follows the logarithm of the longest chain.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = stage(edges, "links")
    before = None
    while (now := _tally(edges)) != before:
        before = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), "links")
        small = _towards_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            small.select("u", F.col("m").alias("v"))
        )
        edges = stage(small.where("u <> v").distinct(), "links")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
