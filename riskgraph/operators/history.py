"""What commit history tells: co-change, hotspots, ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskgraph.catalog import AS_OF, Graph


def since(days: int | None, as_of: str = AS_OF, inclusive: bool = False):
    """Condition on ``date`` for a trailing window; none means all of history."""
    if days is None:
        return F.lit(True)
    edge = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return F.col("date") >= edge if inclusive else F.col("date") > edge


def co_changes(
    changed: DataFrame, commit: DataFrame, min_support: int = 5, min_confidence: float = 0.0, days: int | None = None, most_files: int | None = None, as_of: str = AS_OF
) -> DataFrame:
    """Rows (path1, path2, support, confidence), path1 < path2, of files that change in the same commits.

    Commits are reduced to distinct (sha, path) first. A commit with more than ``most_files``
    files, where that is set, says nothing about its files. Support that cannot reach the
    threshold is cut before pairs are made: a file in fewer commits is in no pair.
    """
    rows = changed.join(commit.filter(since(days, as_of)).select("sha"), "sha").select("sha", "path").distinct()
    alone = rows.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support)
    if most_files is not None:
        fit = rows.groupBy("sha").agg(F.count("*").alias("files")).filter(F.col("files").between(2, most_files)).select("sha")
        rows = rows.join(fit, "sha")
    rows = rows.join(alone.select("path"), "path")
    one, two = rows.withColumnRenamed("path", "path1"), rows.withColumnRenamed("path", "path2")
    pairs = one.join(two, "sha").filter("path1 < path2").groupBy("path1", "path2").agg(F.count("*").alias("support")).filter(F.col("support") >= min_support)
    pairs = pairs.join(alone.select(F.col("path").alias("path1"), F.col("n").alias("n1")), "path1").join(alone.select(F.col("path").alias("path2"), F.col("n").alias("n2")), "path2")
    confidence = (F.col("support") / F.col("n1") + F.col("support") / F.col("n2")) / 2.0
    return pairs.select("path1", "path2", "support", confidence.alias("confidence")).filter(F.col("confidence") >= min_confidence)


def partners(pairs: DataFrame) -> DataFrame:
    """Pairs in both directions: rows (path, partner, support, confidence)."""
    back = pairs.select(F.col("path2").alias("path"), F.col("path1").alias("partner"), "support", "confidence")
    return pairs.select(F.col("path1").alias("path"), F.col("path2").alias("partner"), "support", "confidence").unionByName(back)


def partners_of(changed: DataFrame, commit: DataFrame, wanted: DataFrame, min_support: int = 5, days: int | None = None, as_of: str = AS_OF) -> DataFrame:
    """Rows (path, partner, support, confidence) of the wanted files only: the same as of all pairs, but others are never paired."""
    rows = changed.join(commit.filter(since(days, as_of)).select("sha"), "sha").select("sha", "path").distinct()
    alone = rows.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support)
    mine = rows.join(wanted.select("path").distinct(), "path", "left_semi")
    pairs = mine.join(rows.withColumnRenamed("path", "partner"), "sha").filter("path <> partner").groupBy("path", "partner").agg(F.count("*").alias("support")).filter(F.col("support") >= min_support)
    pairs = pairs.join(alone.withColumnRenamed("n", "n1"), "path").join(alone.select(F.col("path").alias("partner"), F.col("n").alias("n2")), "partner")
    return pairs.select("path", "partner", "support", ((F.col("support") / F.col("n1") + F.col("support") / F.col("n2")) / 2.0).alias("confidence"))


def hotspot_score(changes, methods, lines):
    return changes * 1.0 + F.coalesce(methods, F.lit(0)) / 20.0 + F.coalesce(lines, F.lit(0)) / 1000.0


def recent_changes(g: Graph, days: int | None, as_of: str = AS_OF, inclusive: bool = False) -> DataFrame:
    """Rows (path, change_count): distinct commits in the window."""
    rows = g.changed.join(g.commit.filter(since(days, as_of, inclusive)).select("sha"), "sha")
    return rows.groupBy("path").agg(F.count_distinct("sha").alias("change_count"))


def hotspots(g: Graph, days: int | None = 180, min_changes: int = 1, as_of: str = AS_OF) -> DataFrame:
    rows = recent_changes(g, days, as_of).filter(F.col("change_count") >= min_changes).join(g.file, "path")
    score = hotspot_score(F.col("change_count"), F.col("method_count"), F.col("total_lines"))
    return rows.select("path", F.col("change_count").alias("recent_changes"), "method_count", "total_lines", score.alias("score"))


def ownership(g: Graph, prefix: str, days: int | None = None, as_of: str = AS_OF) -> DataFrame:
    """Per developer in a path prefix: commits, files, last date, share of all commits counted per author."""
    rows = g.authored_changes.filter(F.col("path").startswith(prefix) & since(days, as_of, True))
    out = rows.groupBy("email", "name").agg(F.count_distinct("sha").alias("commits"), F.count_distinct("path").alias("files_touched"), F.max("date").alias("last_commit"))
    total = F.sum("commits").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return out.withColumn("share", F.col("commits") / total)


def bus_factor(rows: DataFrame, by: str, who: str = "email", commits: str = "commits") -> DataFrame:
    """Rows (by, bus_factor): the fewest people who together made half of the commits."""
    order = W.partitionBy(by).orderBy(F.desc(commits), who)
    rows = rows.withColumn("cum", F.sum(commits).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("k", F.row_number().over(order))
    rows = rows.withColumn("all", F.sum(commits).over(W.partitionBy(by)))
    return rows.filter(F.col("cum") * 2 >= F.col("all")).groupBy(by).agg(F.min("k").alias("bus_factor"))
