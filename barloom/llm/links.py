"""Connected components of a link table, as joins and groupings; nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, root): each linked node's smallest reachable node. links: (a, b) longs; self-links and repeats are harmless.

    Alternating star contraction: every node's neighbours are first tied to its smallest neighbour, then larger nodes to
    smaller ones, until nothing changes; the rounds grow with the logarithm of a component's size. Each round is written
    to the shared folder. Frequent nodes are aggregated before the shuffle, and their joins are skew joins."""
    edges = durable(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    before = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(lowest.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct()
        edges = durable(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
