"""Ancestors and descendants along inheritance edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.durable import Stage


def ancestors(edges: DataFrame, depth: int) -> DataFrame:
    """Rows (node, ancestor, steps) for chains of up to ``depth`` edges (child, parent); least steps count.

    Each round joins only the newest rows, so a cycle ends when it finds nothing new.
    """
    step = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct()
    up = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    newest = step.withColumn("steps", F.lit(1))
    found = newest
    for d in range(2, depth + 1):
        newest = newest.join(up, "ancestor").select("node", F.col("next").alias("ancestor")).distinct()
        newest = newest.join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("steps", F.lit(d))
        found = found.unionByName(newest)
    return found


def chains(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Rows (chain, size): every path upwards from the start nodes, of any length, as arrays of keys.

    A round extends the newest paths by one edge and writes them; it ends when none grows.
    A node comes once in a path, so cycles end.
    """
    stage = Stage(edges.sparkSession, "chains")
    up = edges.select(F.col("child").alias("last"), F.col("parent").alias("next")).distinct()
    paths = start.select(F.array("child").alias("chain"), F.col("child").alias("last")).distinct()
    out = None
    while out is None or not paths.isEmpty():
        paths = paths.join(up, "last").filter(~F.array_contains("chain", F.col("next")))
        paths = stage.keep(paths.select(F.concat("chain", F.array("next")).alias("chain"), F.col("next").alias("last")))
        out = paths if out is None else out.unionByName(paths)
    return out.select("chain", F.size("chain").alias("size"))
