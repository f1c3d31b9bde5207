"""Connected components of a link table by alternating large-star and small-star steps.

Both steps keep only joins and grouped minima on links, so nothing gathers a component in a task;
each round's links are written to the shared folder, which ends the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component for every linked node but the smallest of its component; component is the
    smallest node reachable."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    e = materialise(e, "links")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1000003).alias("h"), F.sum("v").alias("s")).first()
        if now == state or not now.n:
            break
        state = now
        e = materialise(_small(_large(e)), "links")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
