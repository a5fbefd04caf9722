"""Reachability of vulnerable calls from entry points: frontier, hops, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskgraph.catalog import Graph
from riskgraph.durable import Stage

MAX_HOPS, LEAST_HOPS, MOST_HOPS = 6, 1, 12
# Annotations that make a method an entry point of an application.
ENTRY_ANNOTATIONS = (
    "RestController", "Controller", "RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping",
    "PatchMapping", "MessageMapping", "KafkaListener", "JmsListener", "RabbitListener", "Scheduled", "EventListener",
    "Path", "GET", "POST", "PUT", "DELETE",
)


def clamped(hops: int) -> int:
    return max(LEAST_HOPS, min(MOST_HOPS, int(hops)))


def entries(g: Graph, sets: tuple[str, ...] = ("annotated",), annotations: tuple[str, ...] = ENTRY_ANNOTATIONS, tests: bool = False) -> DataFrame:
    """Signatures of entry methods by any of the sets annotated, main and public.

    annotated: the method, or for a public one its class, carries one of the annotations.
    Test methods are left out unless ``tests``; the public set never has them.
    """
    unknown = set(sets) - {"annotated", "main", "public"}
    if unknown or not sets:
        raise ValueError(f"entry sets are annotated, main and public, not {sorted(unknown)}")
    m = g.method
    marked = g.annotated.filter(F.col("name").isin(*annotations)).select("method_signature").distinct().withColumn("on_method", F.lit(True))
    typed = g.type_annotated.filter(F.col("annotation").isin(*annotations)).select(F.col("name").alias("class_name"), "file").distinct().withColumn("on_class", F.lit(True))
    m = m.join(marked, "method_signature", "left").join(typed, ["class_name", "file"], "left")
    conditions: list[Column] = []
    if "annotated" in sets:
        conditions.append(F.coalesce("on_method", F.lit(False)) | (F.col("is_public") & F.coalesce("on_class", F.lit(False))))
    if "main" in sets:
        conditions.append((F.col("name") == "main") & F.col("is_static") & F.col("is_public"))
    if "public" in sets:
        conditions.append(F.col("is_public") & ~F.col("is_test_method"))
    either = conditions[0]
    for c in conditions[1:]:
        either = either | c
    if not tests:
        either = either & ~F.coalesce("is_test_method", F.lit(False))
    return m.filter(either).select("method_signature")


def frontier(g: Graph, least_rank: int = 1, only: Column | None = None) -> DataFrame:
    """Rows (cve_id, dep_id, import_path, method_signature, ...): methods that call into vulnerable imports, of the vulnerabilities that meet a condition."""
    calls = g.calls_external.filter(F.col("confidence_rank") >= least_rank)
    edges = g.affects.select("cve_id", "dep_id")
    return (edges if only is None else edges.filter(only)).join(g.depends_on, "dep_id").join(calls, "import_path")


def hops_from(entry: DataFrame, edges: DataFrame, hops: int = MAX_HOPS, stage: Stage | None = None) -> DataFrame:
    """Rows (node, hops): the least number of calls from any entry, 0 for entries themselves.

    Level by level with a visited set: a node is met once however many paths lead to it, and
    each level is written, so no level is computed twice.
    """
    stage = stage or Stage(entry.sparkSession, "hops")
    calls = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    level = stage.keep(entry.select(F.col("method_signature").alias("node")).distinct().withColumn("hops", F.lit(0)))
    seen = level
    for h in range(1, clamped(hops) + 1):
        new = level.select("node").join(calls, "node").select(F.col("next").alias("node")).distinct()
        level = stage.keep(new.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(h)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def routes_to(frontiers: DataFrame, edges: DataFrame, hops: int = MAX_HOPS, stage: Stage | None = None) -> DataFrame:
    """Rows (frontier, node, hops, route): a shortest call path from each node to each frontier method.

    The search runs backwards from the frontier, which is small, with one row per frontier
    and node; of equally short paths the one least by the next method's signature is kept.
    """
    stage = stage or Stage(frontiers.sparkSession, "routes")
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("prev")).distinct()
    level = frontiers.select(F.col("method_signature").alias("frontier")).distinct()
    level = stage.keep(level.select("frontier", F.col("frontier").alias("node"), F.lit(0).alias("hops"), F.array("frontier").alias("route")))
    seen = level
    for h in range(1, clamped(hops) + 1):
        new = level.join(back, "node").groupBy("frontier", F.col("prev").alias("at")).agg(F.min(F.struct("node", "route")).alias("via"))
        new = new.select("frontier", F.col("at").alias("node"), F.lit(h).alias("hops"), F.concat(F.array("at"), F.col("via.route")).alias("route"))
        level = stage.keep(new.join(seen.select("frontier", "node"), ["frontier", "node"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def reachability(g: Graph, hops: int = MAX_HOPS, sets: tuple[str, ...] = ("annotated",), least_rank: int = 1, examples: int = 3, only: Column | None = None) -> DataFrame:
    """For each vulnerability, dependency and frontier method that entries reach: least hops and example routes.

    ``only``: a condition on cve_id that holds before any route is looked for.
    """
    front = frontier(g, least_rank, only)
    best = front.groupBy("cve_id", "dep_id", "method_signature").agg(F.max("confidence_rank").alias("confidence_rank"))
    reached = routes_to(front, g.calls, hops).join(entries(g, sets).withColumnRenamed("method_signature", "node"), "node")
    # the nearest entries of a frontier method are picked before any are gathered
    order = W.partitionBy("frontier").orderBy("hops", "node", "route")
    nearest = reached.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= examples)
    shown = nearest.groupBy("frontier").agg(F.min("hops").alias("min_hops"), F.sort_array(F.collect_list(F.struct("hops", F.col("node").alias("entry"), "route"))).alias("routes"))
    return best.join(shown.withColumnRenamed("frontier", "method_signature"), "method_signature")


def triage(g: Graph, least_cvss: float = 0.0, hops: int = MAX_HOPS, sets: tuple[str, ...] = ("annotated",), least_rank: int = 1, reached: DataFrame | None = None) -> DataFrame:
    """Status of every vulnerability that affects a dependency, all in one pass; ``reached`` are the hops from entries, if known.

    REACHABLE: entries reach a frontier method; FRONTIER_UNREACHABLE: there is one, but none
    is reached; NO_FRONTIER: imports, but no call into them; NOT_IMPORTED: no import.
    """
    cves = g.cve.filter(F.coalesce("cvss_score", F.lit(0.0)) >= least_cvss).withColumnRenamed("id", "cve_id")
    base = cves.join(g.affects, "cve_id").join(g.depends_on, "dep_id", "left")
    reached = (hops_from(entries(g, sets), g.calls, hops) if reached is None else reached).withColumnRenamed("node", "method_signature")
    calls = g.calls_external.filter(F.col("confidence_rank") >= least_rank).select("import_path", "method_signature").distinct()
    calls = calls.join(reached, "method_signature", "left")
    out = base.join(calls, "import_path", "left").groupBy("cve_id", "cvss_score", "severity").agg(
        F.count_distinct("dep_id").alias("dependency_count"), F.count_distinct("import_path").alias("import_count"),
        F.count_distinct("method_signature").alias("frontier_count"),
        F.count_distinct(F.when(F.col("hops").isNotNull(), F.col("method_signature"))).alias("reachable_frontier_count"), F.min("hops").alias("min_hops"),
    )
    status = F.when(F.col("reachable_frontier_count") > 0, "REACHABLE").when(F.col("frontier_count") > 0, "FRONTIER_UNREACHABLE")
    return out.withColumn("status", status.when(F.col("import_count") > 0, "NO_FRONTIER").otherwise("NOT_IMPORTED"))


def best_evidence(g: Graph, reached: DataFrame, least_rank: int = 1) -> DataFrame:
    """Rows (cve_id, rank, hops, method_signature): of each vulnerability the surest frontier method that entries reach, then the nearest, then the least."""
    front = frontier(g, least_rank).join(reached.withColumnRenamed("node", "method_signature"), "method_signature")
    best = front.groupBy("cve_id").agg(F.min(F.struct((-F.col("confidence_rank")).alias("rank"), "hops", "method_signature")).alias("h"))
    return best.select("cve_id", (-F.col("h.rank")).alias("rank"), "h.hops", "h.method_signature")


def reduction(statuses: DataFrame) -> DataFrame:
    """One row: vulnerabilities, reachable ones, and by how many percent triage shortens the list."""
    out = statuses.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "REACHABLE").alias("reachable"))
    share = F.when(F.col("total") > 0, F.round(100 * (F.col("total") - F.col("reachable")) / F.col("total"), 1)).otherwise(0.0)
    return out.withColumn("reduction_pct", share)
