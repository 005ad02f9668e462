"""Connected components of a link table by alternating star contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without links to others don't appear.

    A large star hands a node's larger neighbours to its smallest one, a small star its other neighbours; after about
    log(n) rounds every node hangs on its component's smallest.  Hubs are aggregated before the shuffle.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges = stored(edges, "cc")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join may split a hub's neighbours
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(turned.filter("u > v").unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        discard(links.sparkSession, edges, least)
        edges = new
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
