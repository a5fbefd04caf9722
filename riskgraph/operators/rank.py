"""Degree and PageRank of methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.durable import Stage

DAMPING, ITERATIONS = 0.85, 20


def degrees(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes with out_degree, in_degree and total_degree; every edge counts, parallel ones too."""
    out = edges.groupBy("src").agg(F.count("*").alias("out_degree")).withColumnRenamed("src", key)
    into = edges.groupBy("dst").agg(F.count("*").alias("in_degree")).withColumnRenamed("dst", key)
    df = nodes.join(out, key, "left").join(into, key, "left").fillna(0, ["out_degree", "in_degree"])
    return df.withColumn("total_degree", F.col("out_degree") + F.col("in_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, key: str, damping: float = DAMPING, iterations: int = ITERATIONS, keep_every: int = 5) -> DataFrame:
    """Rows (key, pagerank): unnormalised, 1 - d plus d times what comes in, a fixed number of rounds.

    Nothing is handed on from nodes without outgoing edges. Contributions are summed with
    partial sums; every few rounds the scores are written, so lineage and retries stay short.
    """
    stage = Stage(nodes.sparkSession, "pagerank")
    out = edges.groupBy("src").agg(F.count("*").alias("n"))
    links = stage.keep(edges.join(out, "src").select(F.col("src").alias(key), "dst", "n"))
    ids = stage.keep(nodes.select(key).distinct())
    scores = ids.withColumn("pagerank", F.lit(1.0 - damping))
    for i in range(1, iterations + 1):
        given = links.join(scores, key).groupBy(F.col("dst").alias(key)).agg(F.sum(F.col("pagerank") / F.col("n")).alias("in"))
        scores = ids.join(given, key, "left").select(key, (F.lit(1.0 - damping) + damping * F.coalesce("in", F.lit(0.0))).alias("pagerank"))
        if i % keep_every == 0 and i < iterations:
            scores = stage.keep(scores)
    return scores
