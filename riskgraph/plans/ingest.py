"""Operators of ingest, resolution and upkeep, applied to the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.catalog import Graph
from riskgraph.functions import names
from riskgraph.functions.risk import severity
from riskgraph.operators import community, incremental, ladders, matching
from riskgraph.plans.registry import query, top
from riskgraph.sources.java_source import directories

query("W1_directories", """
SELECT DISTINCT d AS path, regexp_extract(d, '^(.*)/[^/]*$', 1) AS parent FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM g_file UNION ALL SELECT split_part(path, '/', 1) FROM g_file)""")(  # fmt: skip
    lambda g: directories(g.file.select("path"))
)


@query("J3_type_ladder", """
WITH r AS (SELECT cid AS ref, name, CASE WHEN cid % 2 = 0 THEN package ELSE 'none' END AS package, CASE WHEN cid % 3 = 0 THEN file ELSE 'none' END AS file FROM g_type),
a AS (SELECT r.ref, t.name, t.file, 1 AS rung FROM r JOIN g_type t ON t.name = r.name AND t.package = r.package UNION ALL SELECT r.ref, t.name, t.file, 2 FROM r JOIN g_type t ON t.name = r.name AND t.file = r.file
  UNION ALL SELECT r.ref, t.name, t.file, 3 FROM r JOIN g_type t ON t.name = r.name WHERE (SELECT count(*) FROM g_type u WHERE u.name = r.name) = 1)
SELECT DISTINCT ref, name AS target_name, file AS target_file FROM a WHERE rung = (SELECT min(rung) FROM a b WHERE b.ref = a.ref)""")  # fmt: skip
def type_ladder(g: Graph) -> DataFrame:
    package = F.when(F.col("cid") % 2 == 0, F.col("package")).otherwise("none")
    file = F.when(F.col("cid") % 3 == 0, F.col("file")).otherwise("none")
    refs = g.type.select(F.col("cid").alias("ref"), "name", package.alias("package"), file.alias("file"))
    return ladders.type_references(refs, g.type).select("ref", F.col("target.name").alias("target_name"), F.col("target.file").alias("target_file"))


@query("W7_frontier_merge", "SELECT method_signature AS src, import_path, method_name, max(confidence_rank) AS confidence_rank, max(call_count) AS call_count FROM (SELECT * FROM g_calls_external UNION ALL SELECT method_signature, import_path, method_name, 1, call_count + 1 FROM g_calls_external WHERE call_count = 1) GROUP BY 1, 2, 3")
def frontier_merge(g: Graph) -> DataFrame:
    old = g.calls_external.withColumnRenamed("method_signature", "src")
    new = old.filter("call_count = 1").withColumn("confidence_rank", F.lit(1)).withColumn("call_count", F.col("call_count") + 1)
    return ladders.merged_frontier(old, new)


@query("J11_import_dependencies", """
WITH i AS (SELECT package || '.Core.Deep' AS import_path FROM g_dependency), d AS (SELECT dep_id, group_id AS name FROM g_dependency UNION SELECT dep_id, package FROM g_dependency),
h AS (SELECT DISTINCT import_path, array_to_string(list_slice(string_split(import_path, '.'), 1, n), '.') AS head FROM i, (SELECT unnest([2, 3, 4]) AS n) WHERE n <= len(string_split(import_path, '.')))
SELECT DISTINCT import_path, dep_id FROM h JOIN d ON head = name OR starts_with(name, head || '.') OR starts_with(head, name || '.')""")  # fmt: skip
def import_dependencies(g: Graph) -> DataFrame:
    imports = g.dependency.select(F.concat("package", F.lit(".Core.Deep")).alias("import_path"))
    return matching.import_dependencies(imports, g.dependency)


@query("I6_patch", "SELECT method_signature, file, name FROM g_method WHERE file NOT LIKE 'src/m3/%' UNION ALL SELECT method_signature, file, 'new' FROM g_method WHERE file LIKE 'src/m3/%' AND estimated_lines % 2 = 0")
def patch(g: Graph) -> DataFrame:
    """One folder's files change: half of their methods go, the rest have another name."""
    methods = g.method.select("method_signature", "file", "name")
    fresh = g.method.filter(F.col("file").startswith("src/m3/") & (F.col("estimated_lines") % 2 == 0)).select("method_signature", "file", F.lit("new").alias("name"))
    touched = g.file.filter(F.col("path").startswith("src/m3/")).select("path", F.lit("extract").alias("action"))
    return incremental.patched({"method": methods}, {"method": fresh}, touched)["method"]


query("I5_used_imports", "SELECT DISTINCT d.import_path FROM g_depends_on d WHERE EXISTS (SELECT 1 FROM g_imports i WHERE i.import_path = d.import_path)")(
    lambda g: incremental.without_orphans(g.depends_on.select("import_path").distinct(), g.imports)
)
query("I7_new_commits", "SELECT sha FROM g_commit WHERE cast(sha AS bigint) % 3 = 0")(lambda g: incremental.new_commits(g.commit.select("sha"), g.commit.filter(F.col("sha").cast("long") % 3 != 0)))
query("D1_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(lambda g: incremental.repeated_keys(g.source("lineitem"), "l_orderkey", "l_linenumber"))
query("U2_test_paths", "SELECT path, path LIKE '%/m9/%' AS is_test FROM g_file")(lambda g: g.file.select("path", names.in_test_path(F.replace("path", F.lit("m9"), F.lit("test"))).alias("is_test")))
# all the ways in which a path can be one of tests, and near misses
_PLACES = ("/src/test/A.java", "src/test/A.java", "x/tests/A.java", "tests/A.java", "x\\test\\A.java", "Test/A.java", "src/testing/A.java", "attest/A.java", "contests/A.java")
query("U2_test_places", "SELECT concat(cast(n_nationkey AS string), ':', k) AS place, k < 6 AS is_test FROM nation, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS k)")(
    lambda g: g.source("nation").select("n_nationkey", F.posexplode(F.array(*map(F.lit, _PLACES))).alias("k", "path")).select(F.concat_ws(":", F.col("n_nationkey").cast("string"), F.col("k").cast("string")).alias("place"), names.in_test_path(F.col("path")).alias("is_test"))
)
query("U13_severity", "SELECT id, CASE WHEN cvss_score >= 9 THEN 'CRITICAL' WHEN cvss_score >= 7 THEN 'HIGH' WHEN cvss_score >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM g_cve")(lambda g: g.cve.select("id", severity(F.col("cvss_score")).alias("severity")))
query("J17_class_edges", "SELECT m.class_name || '@' || m.file AS src, n.class_name || '@' || n.file AS dst, count(*) AS weight FROM g_calls c JOIN g_method m ON m.method_signature = c.src JOIN g_method n ON n.method_signature = c.dst GROUP BY 1, 2")(
    lambda g: community.class_edges(g.calls, g.method)
)
query("G7_betweenness")(lambda g: community.betweenness(g.calls))


def method_communities(g: Graph) -> DataFrame:
    return community.louvain(g.calls).select(F.col("node").alias("method_signature"), "community")


query("G9_louvain_methods")(method_communities)
query("G10_louvain_classes")(lambda g: community.louvain(community.class_edges(g.calls, g.method)))
query("Q04_community_sizes")(lambda g: top(method_communities(g).groupBy("community").agg(F.count("*").alias("members")), 10, F.desc("members"), "community"))


@query("Q06_community_modules")
def community_modules(g: Graph) -> DataFrame:
    rows = method_communities(g).join(g.method_type, "method_signature", "left")
    rows = rows.groupBy("community").agg(F.count("*").alias("members"), F.count_distinct("class_name", "file").alias("classes"), F.count_distinct("package").alias("packages"))
    return top(rows, 20, F.desc("members"), "packages", "community")


@query("Q07_fractured_classes")
def fractured_classes(g: Graph) -> DataFrame:
    rows = method_communities(g).join(g.method, "method_signature").groupBy(F.col("class_name").alias("class"), "file").agg(
        F.count("*").alias("methods"), F.count_distinct("community").alias("distinct_communities"), F.slice(F.sort_array(F.collect_set("community")), 1, 5).alias("communities")
    )
    return top(rows.filter("distinct_communities >= 2"), 25, F.desc("distinct_communities"), F.desc("methods"), "class", "file")


@query("Q48_bottlenecks_betweenness")
def bottlenecks(g: Graph) -> DataFrame:
    from riskgraph.plans.centrality import ranked_methods

    rows = ranked_methods(g).join(community.betweenness(g.calls).withColumnRenamed("node", "method_signature"), "method_signature", "left")
    rows = rows.select(F.col("file").alias("path"), "class_name", "name", "method_signature", "pagerank", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), "estimated_lines")
    return top(rows, 20, F.desc("pagerank"), "method_signature")
