"""Components of links between nodes of any type that has an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component): component is the least node that a node reaches. Nodes without a link to another one are absent, null ends link nothing.

    Every node points at the least node it knows of. A round lets each link compare what its two ends point at, hangs the larger of the
    two nodes pointed at below the smaller one, and then halves the ways up by pointing where the node above points. So long chains
    take rounds in the logarithm of their length. A round is aggregations with partial sums and equi joins; it ends in a written table, and
    only whether a link is left that joins two components is asked for.
    """
    links = settle(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct())
    up = settle(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        end = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        # links between roots: as components join, fewer are left
        links = settle(links.join(end("a"), "a").join(end("b"), "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
        if links.isEmpty():
            return up.select("node", F.col("root").alias("component"))
        # a root hangs below the least root it has a link to; those ways only lead down in order, so they end
        hung = settle(links.groupBy("a").agg(F.min("b").alias("to")))
        while True:
            above = hung.select(F.col("a").alias("to"), F.col("to").alias("further"))
            if hung.join(above, "to", "left_semi").isEmpty():
                break
            hung = settle(hung.join(above, "to", "left").select("a", F.coalesce("further", "to").alias("to")))
        up = settle(up.join(hung.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
