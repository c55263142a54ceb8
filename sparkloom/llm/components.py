"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each linked node with the smallest node that links reach from it.

    Rounds of large and small stars (each node's larger, then its not larger
    neighbours are linked to the smallest one) until nothing changes; rounds
    grow as the logarithm of the longest path. Minima are combined before each
    shuffle; each round is cut off by a table in the shared folder. Links with a
    null end are left out. Nodes without links don't appear.
    """
    now = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = materialize(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        # large star: neighbours larger than a node go to its lowest neighbour (or itself)
        large = both.join(low, "u").where("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the lowest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        down = small.select("u", F.col("low").alias("v")).union(small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))).distinct()
        after = materialize(down, "links")
        old, new = (x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, after))
        now = after
        if old == new:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
