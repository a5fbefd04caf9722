"""Vulnerabilities: exposure, reachability, triage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskgraph.catalog import Graph
from riskgraph.functions.risk import risk_score
from riskgraph.operators import reach
from riskgraph.plans.architecture import EXPOSED
from riskgraph.plans.registry import query, top

ENTRY = "SELECT DISTINCT m.method_signature FROM g_method m JOIN g_annotated x ON x.method_signature = m.method_signature WHERE x.name = 'GetMapping' AND NOT m.is_test_method UNION SELECT m.method_signature FROM g_method m JOIN g_type_annotated t ON t.name = m.class_name AND t.file = m.file WHERE m.is_public AND NOT m.is_test_method"
HOPS = f"""e AS ({ENTRY}), walk(node, hops) AS (
  SELECT method_signature, 0 FROM e UNION SELECT c.dst, hops + 1 FROM walk JOIN g_calls c ON c.src = walk.node WHERE hops < 6),
least AS (SELECT node, min(hops) AS hops FROM walk GROUP BY 1)"""
TRIAGE = f"""WITH RECURSIVE {HOPS},
t AS (SELECT c.id AS cve_id, c.cvss_score, c.severity, count(DISTINCT a.dep_id) AS dependency_count, count(DISTINCT d.import_path) AS import_count,
  count(DISTINCT x.method_signature) AS frontier_count, count(DISTINCT CASE WHEN l.hops IS NOT NULL THEN x.method_signature END) AS reachable_frontier_count, min(l.hops) AS min_hops
  FROM g_cve c JOIN g_affects a ON a.cve_id = c.id LEFT JOIN g_depends_on d ON d.dep_id = a.dep_id LEFT JOIN g_calls_external x ON x.import_path = d.import_path
  LEFT JOIN least l ON l.node = x.method_signature GROUP BY 1, 2, 3),
s AS (SELECT *, CASE WHEN reachable_frontier_count > 0 THEN 'REACHABLE' WHEN frontier_count > 0 THEN 'FRONTIER_UNREACHABLE' WHEN import_count > 0 THEN 'NO_FRONTIER' ELSE 'NOT_IMPORTED' END AS status FROM t)"""

query("C4_triage_summary", TRIAGE + " SELECT * FROM s")(reach.triage)
query("C4_triage_reduction", TRIAGE + " SELECT count(*) AS total, count(*) FILTER (status = 'REACHABLE') AS reachable, round(100 * (count(*) - count(*) FILTER (status = 'REACHABLE')) / count(*), 1) AS reduction_pct FROM s")(
    lambda g: reach.reduction(reach.triage(g))
)
query("C16_unreachable_cves", TRIAGE + " SELECT cve_id, status FROM s WHERE status <> 'REACHABLE'")(lambda g: reach.triage(g).filter("status <> 'REACHABLE'").select("cve_id", "status"))
query("C16_risk_register_by_cvss", TRIAGE + " SELECT cve_id, cvss_score, status, min_hops FROM s WHERE cvss_score >= 7.0 ORDER BY cvss_score DESC, cve_id LIMIT 20")(
    lambda g: top(reach.triage(g, 7.0).select("cve_id", "cvss_score", "status", "min_hops"), 20, F.desc("cvss_score"), "cve_id")
)
query("G1_min_hops", f"WITH RECURSIVE {HOPS} SELECT node, hops FROM least")(lambda g: reach.hops_from(reach.entries(g), g.calls))
query("G2_entries", ENTRY)(lambda g: reach.entries(g))
query("G2_entries_public", "SELECT method_signature FROM g_method WHERE is_public AND NOT is_test_method")(lambda g: reach.entries(g, ("public",)))
query("Q59_reachable_frontier", f"""WITH RECURSIVE {HOPS} SELECT a.cve_id, x.method_signature AS frontier, min(l.hops) AS hops FROM g_affects a JOIN g_depends_on d ON d.dep_id = a.dep_id
  JOIN g_calls_external x ON x.import_path = d.import_path JOIN least l ON l.node = x.method_signature GROUP BY 1, 2""")(  # fmt: skip
    lambda g: reach.frontier(g).join(reach.hops_from(reach.entries(g), g.calls).withColumnRenamed("node", "method_signature"), "method_signature")
    .groupBy("cve_id", F.col("method_signature").alias("frontier")).agg(F.min("hops").alias("hops"))
)
query("C3_reachability", f"""WITH RECURSIVE {HOPS} SELECT a.cve_id, a.dep_id, x.method_signature AS frontier, max(x.confidence_rank) AS confidence_rank, min(l.hops) AS min_hops FROM g_affects a
  JOIN g_depends_on d ON d.dep_id = a.dep_id JOIN g_calls_external x ON x.import_path = d.import_path JOIN least l ON l.node = x.method_signature GROUP BY 1, 2, 3""")(  # fmt: skip
    lambda g: reach.reachability(g).select("cve_id", "dep_id", F.col("method_signature").alias("frontier"), "confidence_rank", "min_hops")
)
query("C1_linked_cves", "SELECT c.id, c.cvss_score, c.severity, d.group_id, d.artifact_id, d.version, a.confidence, a.match_type FROM g_cve c JOIN g_affects a ON a.cve_id = c.id JOIN g_dependency d ON d.dep_id = a.dep_id WHERE c.cvss_score >= 7.0")(
    lambda g: g.cve.filter("cvss_score >= 7.0").join(g.affects, F.col("id") == F.col("cve_id")).join(g.dependency, "dep_id").select("id", "cvss_score", "severity", "group_id", "artifact_id", "version", "confidence", "match_type")
)
query("C2_frontier", """SELECT a.cve_id, x.method_signature, max(x.confidence_rank) AS confidence_rank, count(DISTINCT x.import_path || '/' || x.method_name) AS evidence FROM g_affects a
  JOIN g_depends_on d ON d.dep_id = a.dep_id JOIN g_calls_external x ON x.import_path = d.import_path WHERE x.confidence_rank >= 2 GROUP BY 1, 2""")(  # fmt: skip
    lambda g: reach.frontier(g, 2).groupBy("cve_id", "method_signature").agg(F.max("confidence_rank").alias("confidence_rank"), F.count_distinct("import_path", "method_name").alias("evidence"))
)
# one exact coordinate; in the test tables a dependency's key stands for it
query("C8_dependency_cves", "SELECT c.id AS cve_id, c.cvss_score, c.severity, a.confidence, a.match_type, d.group_id, d.artifact_id, d.version FROM g_cve c JOIN g_affects a ON a.cve_id = c.id JOIN g_dependency d ON d.dep_id = a.dep_id WHERE d.dep_id = '7'")(
    lambda g: g.dependency.filter("dep_id = '7'").join(g.affects, "dep_id").join(g.cve, F.col("id") == F.col("cve_id"))
    .select("cve_id", "cvss_score", "severity", "confidence", "match_type", "group_id", "artifact_id", "version")
)
query("Q15_public_api_in_vulnerable_files", f"SELECT i.path, m.class_name, m.name, m.method_signature, c.id AS cve, c.cvss_score, count(*) AS paths FROM {EXPOSED} JOIN g_method m ON m.file = i.path WHERE m.is_public AND c.cvss_score >= 7.0 GROUP BY 1, 2, 3, 4, 5, 6")(
    lambda g: g.exposure.filter("cvss_score >= 7.0").groupBy("path", F.col("cve_id").alias("cve"), "cvss_score").agg(F.count("*").alias("paths"))
    .join(g.method.filter("is_public").withColumnRenamed("file", "path"), "path").select("path", "class_name", "name", "method_signature", "cve", "cvss_score", "paths")
)

_RISK = """SELECT d.dep_id, d.package, d.version, count(DISTINCT a.cve_id) AS vulnerabilities, count(DISTINCT i.path) AS files_using_it, max(c.cvss_score) AS worst
  FROM g_dependency d LEFT JOIN g_affects a ON a.dep_id = d.dep_id LEFT JOIN g_cve c ON c.id = a.cve_id LEFT JOIN g_depends_on o ON o.dep_id = d.dep_id LEFT JOIN g_imports i ON i.import_path = o.import_path GROUP BY 1, 2, 3"""


def dependency_risk(g: Graph) -> DataFrame:
    """Each side is counted on its own, so vulnerabilities and files never multiply."""
    cves = g.affects.join(g.cve, F.col("id") == F.col("cve_id")).groupBy("dep_id").agg(F.count_distinct("cve_id").alias("vulnerabilities"), F.max("cvss_score").alias("worst"))
    files = g.file_dependency.groupBy("dep_id").agg(F.count("*").alias("files_using_it"))
    rows = g.dependency.join(cves, "dep_id", "left").join(files, "dep_id", "left").fillna(0, ["vulnerabilities", "files_using_it"])
    return rows.select("dep_id", "package", "version", "vulnerabilities", "files_using_it", "worst")


query("Q16_dependency_risk", _RISK)(dependency_risk)
query("Q46_dependency_risk_score", f"WITH r AS ({_RISK}) SELECT *, vulnerabilities * files_using_it + coalesce(worst, 0) AS risk_score FROM r ORDER BY risk_score DESC, dep_id LIMIT 50")(
    lambda g: top(dependency_risk(g).withColumn("risk_score", F.col("vulnerabilities") * F.col("files_using_it") + F.coalesce("worst", F.lit(0.0))), 50, F.desc("risk_score"), "dep_id")
)


@query("Q23_exposed_files", f"SELECT c.id AS cve, c.cvss_score AS cvss, a.dep_id, a.confidence, list_aggregate(list_slice(list_sort(list(DISTINCT i.path)), 1, 10), 'string_agg', ',') AS exposed_files FROM {EXPOSED} WHERE c.cvss_score >= 7.0 GROUP BY 1, 2, 3, 4")
def exposed_files(g: Graph) -> DataFrame:
    rows = g.exposure.filter("cvss_score >= 7.0").select(F.col("cve_id").alias("cve"), F.col("cvss_score").alias("cvss"), "dep_id", "confidence", "path").distinct()
    keys = ["cve", "cvss", "dep_id", "confidence"]
    # ten files of each are kept before they are gathered
    first = rows.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("path"))).filter("k <= 10")
    return first.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("exposed_files"))


query("Q24_zero_import_exposure", "SELECT a.cve_id AS cve, c.cvss_score AS cvss, a.dep_id FROM g_affects a JOIN g_cve c ON c.id = a.cve_id WHERE NOT EXISTS (SELECT 1 FROM g_depends_on d WHERE d.dep_id = a.dep_id)")(
    lambda g: g.affects.join(g.depends_on, "dep_id", "left_anti").join(g.cve, F.col("id") == F.col("cve_id")).select(F.col("cve_id").alias("cve"), F.col("cvss_score").alias("cvss"), "dep_id")
)
query("Q38_why_linked", "SELECT d.group_id, d.artifact_id, d.version, a.confidence, a.match_type, c.severity, c.cvss_score FROM g_cve c JOIN g_affects a ON a.cve_id = c.id JOIN g_dependency d ON d.dep_id = a.dep_id WHERE c.id = 'CVE-2024-0007'")(
    lambda g: g.cve.filter("id = 'CVE-2024-0007'").join(g.affects, F.col("id") == F.col("cve_id")).join(g.dependency, "dep_id").select("group_id", "artifact_id", "version", "confidence", "match_type", "severity", "cvss_score")
)
query("Q39_low_confidence", "SELECT a.cve_id, d.group_id, d.artifact_id, d.version, a.confidence, a.match_type FROM g_affects a JOIN g_dependency d ON d.dep_id = a.dep_id WHERE a.confidence < 0.9")(
    lambda g: g.affects.filter("confidence < 0.9").join(g.dependency, "dep_id").select("cve_id", "group_id", "artifact_id", "version", "confidence", "match_type")
)
query("Q43_security_surface", f"""SELECT i.path, m.class_name, m.name, m.method_signature, c.cvss_score, list_aggregate(list_sort(list(DISTINCT a.dep_id)), 'string_agg', ',') AS dependencies,
  list_aggregate(list_sort(list(DISTINCT c.id)), 'string_agg', ',') AS vulnerabilities FROM {EXPOSED} JOIN g_method m ON m.file = i.path WHERE m.is_public GROUP BY 1, 2, 3, 4, 5""")(  # fmt: skip
    lambda g: g.exposure.groupBy("path", "cvss_score").agg(F.array_join(F.sort_array(F.collect_set("dep_id")), ",").alias("dependencies"), F.array_join(F.sort_array(F.collect_set("cve_id")), ",").alias("vulnerabilities"))
    .join(g.method.filter("is_public").withColumnRenamed("file", "path"), "path").select("path", "class_name", "name", "method_signature", "cvss_score", "dependencies", "vulnerabilities")
)
query("Q44_critical_cve_impact", f"""SELECT c.id, c.cvss_score, c.description, a.dep_id, count(DISTINCT i.path) AS affected_files, count(DISTINCT m.method_signature) AS exposed_public_methods
  FROM {EXPOSED} LEFT JOIN g_method m ON m.file = i.path AND m.is_public WHERE c.cvss_score >= 7.0 GROUP BY 1, 2, 3, 4""")(  # fmt: skip
    lambda g: g.exposure.filter("cvss_score >= 7.0").select(F.col("cve_id").alias("id"), "cvss_score", "description", "dep_id", "path").distinct()
    .join(g.method.filter("is_public").groupBy(F.col("file").alias("path")).agg(F.count("*").alias("n")), "path", "left")
    .groupBy("id", "cvss_score", "description", "dep_id").agg(F.count("*").alias("affected_files"), F.sum(F.coalesce("n", F.lit(0))).alias("exposed_public_methods"))
)
query("Q51_dependency_network", "SELECT DISTINCT i.path, d.dep_id, a.cve_id FROM g_imports i JOIN g_depends_on d ON d.import_path = i.import_path LEFT JOIN g_affects a ON a.dep_id = d.dep_id ORDER BY 1, 2, 3 LIMIT 100")(
    lambda g: top(g.file_dependency.join(g.affects.select("dep_id", "cve_id"), "dep_id", "left").select("path", "dep_id", "cve_id").distinct(), 100, "path", "dep_id", "cve_id")
)
query("Q58_cve_files", f"SELECT DISTINCT i.path AS file, a.dep_id FROM {EXPOSED} WHERE c.id = 'CVE-2024-0007'")(lambda g: g.exposure.filter("cve_id = 'CVE-2024-0007'").select(F.col("path").alias("file"), "dep_id").distinct())
query("Q61_vulnerable_complex_files", f"SELECT i.path AS file_path, count(DISTINCT c.id) AS vulnerability_count FROM {EXPOSED} JOIN g_file f ON f.path = i.path WHERE c.cvss_score >= 7.0 AND f.total_lines > 100 AND f.method_count > 5 GROUP BY 1")(
    lambda g: g.exposure.filter("cvss_score >= 7.0").join(g.file.filter("total_lines > 100 and method_count > 5"), "path").groupBy(F.col("path").alias("file_path")).agg(F.count_distinct("cve_id").alias("vulnerability_count"))
)
query("Q67_severe_count", "SELECT count(*) AS severe, count(*) FILTER (d.version IS NULL) AS unversioned FROM g_affects a JOIN g_cve c ON c.id = a.cve_id JOIN g_dependency d ON d.dep_id = a.dep_id WHERE c.severity IN ('CRITICAL', 'HIGH')")(
    lambda g: g.cve.filter(F.col("severity").isin("CRITICAL", "HIGH")).join(g.affects, F.col("id") == F.col("cve_id")).join(g.dependency, "dep_id").agg(F.count("*").alias("severe"), F.count_if(F.col("version").isNull()).alias("unversioned"))
)
query("Q71_impact_summary", """SELECT c.id AS cve_id, c.description, c.cvss_score, c.severity, count(*) AS dependency_count, list_aggregate(list_sort(list(d.package)), 'string_agg', ',') AS affected_dependencies
  FROM g_cve c JOIN g_affects a ON a.cve_id = c.id JOIN g_dependency d ON d.dep_id = a.dep_id WHERE c.cvss_score >= 7.0 GROUP BY 1, 2, 3, 4 ORDER BY c.cvss_score DESC, c.id LIMIT 50""")(  # fmt: skip
    lambda g: top(
        g.cve.filter("cvss_score >= 7.0").join(g.affects, F.col("id") == F.col("cve_id")).join(g.dependency, "dep_id").groupBy("cve_id", "description", "cvss_score", "severity")
        .agg(F.count("*").alias("dependency_count"), F.array_join(F.sort_array(F.collect_list("package")), ",").alias("affected_dependencies")), 50, F.desc("cvss_score"), "cve_id"
    )
)


def risk_register(g: Graph) -> DataFrame:
    """Vulnerabilities by score: severity weighed by the best evidence and by distance."""
    reached = reach.hops_from(reach.entries(g), g.calls)
    rows = reach.triage(g, 7.0, reached=reached).join(reach.best_evidence(g, reached).drop("method_signature"), "cve_id", "left")
    rows = rows.withColumn("score", risk_score(F.col("cvss_score"), F.coalesce("rank", F.lit(0)), F.col("hops")))
    order = W.orderBy(F.col("rank").isNull(), F.desc("score"), "cve_id")
    return rows.withColumn("position", F.row_number().over(order)).select("position", "cve_id", "cvss_score", "status", "rank", "hops", "score")


query("C12_risk_register", TRIAGE + """, f AS (SELECT a.cve_id, x.method_signature, max(x.confidence_rank) AS rank, min(l.hops) AS hops FROM g_affects a JOIN g_depends_on d ON d.dep_id = a.dep_id
  JOIN g_calls_external x ON x.import_path = d.import_path JOIN least l ON l.node = x.method_signature GROUP BY 1, 2, a.dep_id),
b AS (SELECT cve_id, rank, hops FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY rank DESC, hops) AS k FROM f) WHERE k = 1),
w AS (SELECT s.cve_id, s.cvss_score, s.status, b.rank, b.hops, s.cvss_score * CASE b.rank WHEN 3 THEN 1.0::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 0.05::DOUBLE END
  * CASE WHEN b.rank IS NULL THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + 0.15::DOUBLE * b.hops) END AS score FROM s LEFT JOIN b USING (cve_id) WHERE s.cvss_score >= 7.0)
SELECT row_number() OVER (ORDER BY rank IS NULL, score DESC, cve_id) AS position, * FROM w""")(risk_register)  # fmt: skip
