"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.plans.scale import settle


def _lowest(edges: DataFrame) -> DataFrame:
    """For every node the smallest of its neighbours; combined before the shuffle, so a hub is no hot task."""
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node are linked to the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both)
    linked = both.filter(F.col("v") > F.col("u")).join(low, "u")
    return linked.select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and itself, are linked to the smallest of them."""
    low = _lowest(edges)
    moved = edges.join(low, "u").filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, for every node with a link to another.

    Each round is written to the shared folder, so that a lost executor costs one round;
    rounds grow with the logarithm of a component's width. Null ends and self links are
    left out; repeated links change nothing; no links give an empty table.
    """
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = settle(edges.distinct())
    state = None
    while True:
        edges = settle(_small_star(_large_star(edges)))
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(mark)
