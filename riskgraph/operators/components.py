"""Connected components of links as DataFrames, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.durable import Stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """Rows (node, root) for every node of ``links(u, v)`` other than a root; root is the least node.

    Each round hangs a node's greater neighbours, then its lesser ones, below the least of
    them; minima are pre-aggregated and written before they are joined, so that the join
    shuffles for itself and the rows of a node with very many links can be split, or no link
    is shuffled where the minima are few. It ends when the links are stars. Nothing but two
    numbers reaches the driver in a round.
    """
    edges = stage.keep(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage.keep(large)
        lower = stage.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stage.keep(hung.unionByName(lower.withColumnRenamed("m", "v")).distinct())
        stage.drop(edges, least, large, lower)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
