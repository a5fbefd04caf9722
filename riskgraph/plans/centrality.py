"""Queries that need a graph algorithm's output first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.catalog import Graph
from riskgraph.operators import history
from riskgraph.operators.rank import pagerank
from riskgraph.plans.registry import query, top


def ranked_methods(g: Graph) -> DataFrame:
    return g.method.join(pagerank(g.method, g.calls, "method_signature"), "method_signature")


def nine_places(score: str) -> Column:
    """Cut to nine places a little off the halves, where sums in another order would round apart."""
    return F.floor(F.col(score) * 1e9 + 0.123) / F.lit(1e9)


def _pagerank_sql(select: str, rounds: int = 20) -> str:
    """PageRank as a chain of rounds; every number is the same sum in another order."""
    steps = ["o AS (SELECT src, count(*) AS n FROM g_calls GROUP BY 1)", "r0 AS (SELECT method_signature AS k, 0.15::DOUBLE AS s FROM g_method)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"r{i} AS MATERIALIZED (SELECT m.method_signature AS k, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(x.s, 0) AS s FROM g_method m LEFT JOIN (SELECT c.dst, sum(r.s / o.n) AS s FROM g_calls c JOIN r{i - 1} r ON r.k = c.src JOIN o ON o.src = c.src GROUP BY 1) x ON x.dst = m.method_signature)"
        )
    return "WITH " + ", ".join(steps) + select.replace("RANKS", f"r{rounds}")


query("G6_pagerank", _pagerank_sql(" SELECT k AS method_signature, cast(floor(s * 1e9 + 0.123) AS bigint) AS pagerank_e9 FROM RANKS"))(
    lambda g: pagerank(g.method, g.calls, "method_signature").select("method_signature", F.floor(F.col("pagerank") * 1e9 + 0.123).cast("long").alias("pagerank_e9"))
)
query("Q03_top_central", _pagerank_sql(" SELECT k AS method, class_name AS class, file, floor(s * 1e9 + 0.123) / 1e9 AS score FROM RANKS JOIN g_method ON method_signature = k ORDER BY floor(s * 1e9 + 0.123) / 1e9 DESC, file, class_name, k LIMIT 25"))(
    lambda g: top(ranked_methods(g).select(F.col("method_signature").alias("method"), F.col("class_name").alias("class"), "file", nine_places("pagerank").alias("score")), 25, F.desc("score"), "file", "class", "method")
)
query("Q02_bottlenecks", _pagerank_sql(" SELECT file AS path, class_name, name, k AS method, floor(s * 1e9 + 0.123) / 1e9 AS importance, estimated_lines AS complexity FROM RANKS JOIN g_method ON method_signature = k WHERE s > 0.001 ORDER BY floor(s * 1e9 + 0.123) / 1e9 DESC, k LIMIT 20"))(
    lambda g: top(
        ranked_methods(g).filter("pagerank > 0.001").select(F.col("file").alias("path"), "class_name", "name", F.col("method_signature").alias("method"), nine_places("pagerank").alias("importance"), F.col("estimated_lines").alias("complexity")),
        20, F.desc("importance"), "method",
    )
)


@query("Q05_high_blast_radius", _pagerank_sql("""
, b AS (SELECT c.dst, count(DISTINCT c.src) AS callers, count(DISTINCT t.package) AS caller_packages FROM g_calls c JOIN g_method m ON m.method_signature = c.src JOIN g_type t ON t.name = m.class_name AND t.file = m.file GROUP BY 1)
SELECT k AS method, floor(s * 1e9 + 0.123) / 1e9 AS centrality, coalesce(callers, 0) AS callers, coalesce(caller_packages, 0) AS caller_packages FROM RANKS LEFT JOIN b ON b.dst = k ORDER BY floor(s * 1e9 + 0.123) / 1e9 DESC, 4 DESC, 3 DESC, 1 LIMIT 25"""))  # fmt: skip
def high_blast_radius(g: Graph) -> DataFrame:
    callers = g.calls.join(g.method_type.select(F.col("method_signature").alias("src"), "package"), "src")
    callers = callers.groupBy(F.col("dst").alias("method")).agg(F.count_distinct("src").alias("callers"), F.count_distinct("package").alias("caller_packages"))
    ranks = pagerank(g.method, g.calls, "method_signature").select(F.col("method_signature").alias("method"), nine_places("pagerank").alias("centrality"))
    return top(ranks.join(callers, "method", "left").fillna(0, ["callers", "caller_packages"]), 25, F.desc("centrality"), F.desc("caller_packages"), F.desc("callers"), "method")


@query("Q28_hotspots_by_rank", _pagerank_sql("""
, h AS (SELECT path, count(DISTINCT sha) AS changes FROM g_changed GROUP BY 1), p AS (SELECT file, max(floor(s * 1e9 + 0.123) / 1e9) AS peak FROM RANKS JOIN g_method ON method_signature = k WHERE NOT is_test_method GROUP BY 1)
SELECT file, changes, peak FROM p JOIN h ON h.path = p.file ORDER BY changes * peak DESC, file LIMIT 20"""))  # fmt: skip
def hotspots_by_rank(g: Graph) -> DataFrame:
    peak = ranked_methods(g).filter("not is_test_method").groupBy("file").agg(F.max(nine_places("pagerank")).alias("peak"))
    changes = history.recent_changes(g, None).select(F.col("path").alias("file"), F.col("change_count").alias("changes"))
    return peak.join(changes, "file").select("file", "changes", "peak").orderBy((F.col("changes") * F.col("peak")).desc(), "file").limit(20)


@query("C6_hotspots", _pagerank_sql("""
, h AS (SELECT path, count(DISTINCT sha) AS change_count FROM g_changed GROUP BY 1), p AS (SELECT file, max(floor(s * 1e9 + 0.123) / 1e9) AS peak FROM RANKS JOIN g_method ON method_signature = k GROUP BY 1)
SELECT path, change_count, peak AS peak_pagerank FROM h LEFT JOIN p ON p.file = h.path ORDER BY change_count DESC, coalesce(peak, 0) DESC, path LIMIT 20"""))  # fmt: skip
def central_hotspots(g: Graph) -> DataFrame:
    peak = ranked_methods(g).groupBy(F.col("file").alias("path")).agg(F.max(nine_places("pagerank")).alias("peak_pagerank"))
    rows = history.recent_changes(g, None).join(peak, "path", "left")
    return top(rows, 20, F.desc("change_count"), F.coalesce("peak_pagerank", F.lit(0.0)).desc(), "path")
