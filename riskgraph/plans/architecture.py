"""Structure: complexity, hierarchy, interfaces, calls, documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.catalog import Graph
from riskgraph.operators.hierarchy import ancestors, chains
from riskgraph.operators.rank import degrees
from riskgraph.plans.registry import query, top

EXPOSED = "g_imports i JOIN g_depends_on d ON d.import_path = i.import_path JOIN g_affects a ON a.dep_id = d.dep_id JOIN g_cve c ON c.id = a.cve_id"


def _refactor_sql(lines: int, methods: int) -> str:
    return f"""
SELECT f.path, f.total_lines, f.method_count, f.class_count, count(DISTINCT x.id) AS security_issues,
  f.total_lines * f.method_count + count(x.id) * 100 AS score
FROM g_file f LEFT JOIN (SELECT i.path, c.id FROM {EXPOSED} WHERE c.cvss_score >= 7.0) x ON x.path = f.path
WHERE f.total_lines > {lines} AND f.method_count > {methods} GROUP BY 1, 2, 3, 4 ORDER BY score DESC, 1 LIMIT 25"""


def refactor_candidates(g: Graph, lines: int, methods: int) -> DataFrame:
    """Large files, those with severe vulnerabilities first; every path to one counts."""
    severe = g.exposure.filter("cvss_score >= 7.0").select("path", "cve_id")
    f = g.file.filter((F.col("total_lines") > lines) & (F.col("method_count") > methods)).join(severe, "path", "left")
    out = f.groupBy("path", "total_lines", "method_count", "class_count").agg(F.count_distinct("cve_id").alias("security_issues"), F.count("cve_id").alias("n"))
    out = out.withColumn("score", F.col("total_lines") * F.col("method_count") + F.col("n") * 100).drop("n")
    return top(out, 25, F.desc("score"), "path")


query("Q01_refactor_candidates", _refactor_sql(100, 5))(lambda g: refactor_candidates(g, 100, 5))
query("Q42_complexity_hotspot", _refactor_sql(50, 2))(lambda g: refactor_candidates(g, 50, 2))


@query("Q08_package_churn_fanout", """
WITH churn AS (SELECT k.package, count(*) AS churn FROM g_type k JOIN g_changed h ON h.path = k.file GROUP BY 1),
pairs AS (SELECT DISTINCT a.package AS p, b.package AS q FROM g_calls c JOIN g_method m ON m.method_signature = c.src JOIN g_method n ON n.method_signature = c.dst
  JOIN g_type a ON a.name = m.class_name AND a.file = m.file JOIN g_type b ON b.name = n.class_name AND b.file = n.file WHERE a.package <> b.package)
SELECT p AS package, churn, count(*) AS fanout, churn * count(*) AS risk_score FROM pairs JOIN churn ON churn.package = p GROUP BY 1, 2 ORDER BY risk_score DESC, 1 LIMIT 15""")  # fmt: skip
def package_churn_fanout(g: Graph) -> DataFrame:
    per_file = g.changed.groupBy("path").agg(F.count("*").alias("n"))
    churn = g.type.join(per_file, F.col("file") == F.col("path")).groupBy("package").agg(F.sum("n").alias("churn"))
    of = g.method_type.select("method_signature", "package")
    pairs = g.calls.join(of.withColumnRenamed("method_signature", "src"), "src")
    pairs = pairs.join(of.select(F.col("method_signature").alias("dst"), F.col("package").alias("other")), "dst")
    out = pairs.filter("package <> other").select("package", "other").distinct().groupBy("package").agg(F.count("*").alias("fanout")).join(churn, "package")
    return top(out.select("package", "churn", "fanout", (F.col("churn") * F.col("fanout")).alias("risk_score")), 15, F.desc("risk_score"), "package")


@query("Q09_api_internal_types", """
SELECT m.method_signature AS method, k.package AS api_package, k.name AS api_class, t.package AS internal_package, t.name AS internal_type
FROM g_type k JOIN g_method m ON m.class_name = k.name AND m.file = k.file JOIN g_parameter p ON p.method_signature = m.method_signature
JOIN g_type t ON t.name = p.type AND t.file = p.type_file
WHERE k.package LIKE 'com.app.m4%' AND m.is_public AND t.package LIKE 'com.app.m2%'""")  # fmt: skip
def api_exposes_internal_types(g: Graph) -> DataFrame:
    api = g.method_type.filter(F.col("package").startswith("com.app.m4") & F.col("is_public"))
    kinds = g.type.filter(F.col("package").startswith("com.app.m2")).select(F.col("name").alias("type"), F.col("file").alias("type_file"), F.col("package").alias("internal_package"))
    rows = api.join(g.parameter, "method_signature").join(kinds, ["type", "type_file"])
    return rows.select(F.col("method_signature").alias("method"), F.col("package").alias("api_package"), F.col("class_name").alias("api_class"), "internal_package", F.col("type").alias("internal_type"))


@query("Q10_implementations", "SELECT interface, class_name AS class, class_file AS file FROM g_implements WHERE interface = (SELECT max(name) FROM g_interface WHERE iid = 3)")
def implementations(g: Graph) -> DataFrame:
    wanted = g.interface.filter("iid = 3").select(F.col("name").alias("interface"))
    return g.implements.join(wanted, "interface", "left_semi").select("interface", F.col("class_name").alias("class"), F.col("class_file").alias("file"))


@query("Q11_unimplemented_interfaces", "SELECT name AS interface, file FROM g_interface i WHERE NOT EXISTS (SELECT 1 FROM g_implements x WHERE x.interface = i.name AND x.interface_file = i.file)")
def unimplemented_interfaces(g: Graph) -> DataFrame:
    used = g.implements.select(F.col("interface").alias("name"), F.col("interface_file").alias("file"))
    return g.interface.join(used, ["name", "file"], "left_anti").select(F.col("name").alias("interface"), "file")


@query("Q12_inheritance_chains", """
WITH RECURSIVE up(path, last, n) AS (
  SELECT cast(cid AS string), cid, 1 FROM g_type
  UNION ALL SELECT up.path || '>' || cast(e.parent_id AS string), e.parent_id, n + 1 FROM up JOIN g_extends e ON e.child_id = up.last)
SELECT path AS chain, n AS size FROM up WHERE n > 1 ORDER BY n DESC, path LIMIT 5""")  # fmt: skip
def inheritance_chains(g: Graph) -> DataFrame:
    edges = g.extends.select(F.col("child_id").alias("child"), F.col("parent_id").alias("parent"))
    rows = chains(edges, g.type.select(F.col("cid").alias("child")))
    return top(rows.select(F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"), "size"), 5, F.desc("size"), "chain")


query("Q19_methods_with_docs", "SELECT method_signature AS method, text AS doc, start_line, end_line FROM g_doc WHERE method_signature IS NOT NULL")(
    lambda g: g.doc.filter("method_signature is not null").select(F.col("method_signature").alias("method"), F.col("text").alias("doc"), "start_line", "end_line")
)
query("Q20_classes_with_docs", "SELECT class_name AS class, file, text AS doc, start_line FROM g_doc WHERE class_name IS NOT NULL")(
    lambda g: g.doc.filter("class_name is not null").select(F.col("class_name").alias("class"), "file", F.col("text").alias("doc"), "start_line")
)
query("Q21_top_cyclomatic", "SELECT name AS method, file, cyclomatic_complexity AS cc, method_signature FROM g_method ORDER BY cc DESC, file, name, method_signature LIMIT 25")(
    lambda g: top(g.method.select(F.col("name").alias("method"), "file", F.col("cyclomatic_complexity").alias("cc"), "method_signature"), 25, F.desc("cc"), "file", "method", "method_signature")
)


@query("Q22_deprecated_callers", """
SELECT m.method_signature, m.class_name AS class, m.name AS method, m.deprecated_since AS since, count(c.src) AS callers
FROM g_method m LEFT JOIN g_calls c ON c.dst = m.method_signature WHERE m.deprecated GROUP BY 1, 2, 3, 4""")  # fmt: skip
def deprecated_callers(g: Graph) -> DataFrame:
    callers = g.calls.groupBy(F.col("dst").alias("method_signature")).agg(F.count("*").alias("callers"))
    rows = g.method.filter("deprecated").join(callers, "method_signature", "left").fillna(0, ["callers"])
    return rows.select("method_signature", F.col("class_name").alias("class"), F.col("name").alias("method"), F.col("deprecated_since").alias("since"), "callers")


_DEGREES = """
SELECT m.method_signature, m.name, m.class_name, m.file, m.is_test_method, m.arity, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree
FROM g_method m LEFT JOIN (SELECT src, count(*) AS n FROM g_calls GROUP BY 1) o ON o.src = m.method_signature
LEFT JOIN (SELECT dst, count(*) AS n FROM g_calls GROUP BY 1) i ON i.dst = m.method_signature"""


@query("Q29_hub_methods", f"WITH d AS ({_DEGREES}) SELECT class_name AS class, name, arity, in_degree, method_signature FROM d WHERE NOT is_test_method ORDER BY in_degree DESC, class_name, name, method_signature LIMIT 20")
def hub_methods(g: Graph) -> DataFrame:
    rows = degrees(g.method.filter("not is_test_method"), g.calls, "method_signature")
    return top(rows.select(F.col("class_name").alias("class"), "name", "arity", "in_degree", "method_signature"), 20, F.desc("in_degree"), "class", "name", "method_signature")


query("Q70_degree_top", f"WITH d AS ({_DEGREES}) SELECT method_signature, name AS method_name, class_name, file, out_degree, in_degree, out_degree + in_degree AS total_degree FROM d ORDER BY total_degree DESC, method_signature LIMIT 50")(
    lambda g: top(degrees(g.method, g.calls, "method_signature").select("method_signature", F.col("name").alias("method_name"), "class_name", "file", "out_degree", "in_degree", "total_degree"), 50, F.desc("total_degree"), "method_signature")
)
query("G8_degrees", f"WITH d AS ({_DEGREES}) SELECT method_signature, out_degree, in_degree, out_degree + in_degree AS total_degree FROM d")(
    lambda g: degrees(g.method, g.calls, "method_signature").select("method_signature", "out_degree", "in_degree", "total_degree")
)


@query("Q30_calls_noise", """
WITH h AS (SELECT c.src, m.name, m.class_name AS cls, count(DISTINCT m.method_signature) AS overloads FROM g_calls c JOIN g_method m ON m.method_signature = c.dst GROUP BY 1, 2, 3)
SELECT cls, name, count(*) AS callers, cast(sum(overloads) AS bigint) AS edges FROM h WHERE overloads > 0 GROUP BY 1, 2 ORDER BY edges DESC, cls, name LIMIT 10""")  # fmt: skip
def calls_noise(g: Graph, least: int = 1) -> DataFrame:
    """Callee names by the edges that overloads of one name receive; ``least`` overloads hit by a caller."""
    rows = g.calls.join(g.method.select(F.col("method_signature").alias("dst"), "name", F.col("class_name").alias("cls")), "dst")
    rows = rows.groupBy("src", "cls", "name").agg(F.count_distinct("dst").alias("overloads")).filter(F.col("overloads") >= least)
    return top(rows.groupBy("cls", "name").agg(F.count("*").alias("callers"), F.sum("overloads").alias("edges")), 10, F.desc("edges"), "cls", "name")


query("Q31_implementers", "SELECT t.package, t.name, t.file FROM g_implements x JOIN g_type t ON t.name = x.class_name AND t.file = x.class_file WHERE x.interface = (SELECT max(name) FROM g_interface WHERE iid = 5)")(
    lambda g: g.implements.join(g.interface.filter("iid = 5").select(F.col("name").alias("interface")), "interface", "left_semi")
    .select(F.col("class_name").alias("name"), F.col("class_file").alias("file")).join(g.type, ["name", "file"]).select("package", "name", "file")
)
query("Q32_annotated_types", "SELECT package, name FROM g_type_annotated WHERE annotation = 'RestController'")(lambda g: g.type_annotated.filter("annotation = 'RestController'").select("package", "name"))
query("Q33_annotated_fields", "SELECT owner_name AS class, name AS field, type FROM g_field WHERE autowired")(lambda g: g.field.filter("autowired").select(F.col("owner_name").alias("class"), F.col("name").alias("field"), "type"))
query("Q34_public_mutable_fields", "SELECT owner_name AS class, name AS field, type FROM g_field WHERE is_public AND NOT is_final")(
    lambda g: g.field.filter("is_public and not is_final").select(F.col("owner_name").alias("class"), F.col("name").alias("field"), "type")
)
query("Q35_nested_types", "SELECT parent AS outer_type, child AS nested, kind FROM g_nested")(lambda g: g.nested.select(F.col("parent").alias("outer_type"), F.col("child").alias("nested"), "kind"))
query("Q36_methods_throwing", "SELECT m.class_name, m.name, m.method_signature FROM g_throws t JOIN g_method m ON m.method_signature = t.method_signature WHERE t.exception = 'IOException'")(
    lambda g: g.throws.filter("exception = 'IOException'").join(g.method, "method_signature").select("class_name", "name", "method_signature")
)


@query("Q47_large_files", """
SELECT f.path, f.total_lines, f.method_count, count(m.method_signature) AS large_methods, f.total_lines + count(m.method_signature) * 20 AS complexity_indicator
FROM g_file f LEFT JOIN g_method m ON m.file = f.path AND m.estimated_lines > 40 WHERE f.total_lines > 10 GROUP BY 1, 2, 3 ORDER BY complexity_indicator DESC, 1 LIMIT 50""")  # fmt: skip
def large_files(g: Graph) -> DataFrame:
    large = g.method.filter("estimated_lines > 40").groupBy(F.col("file").alias("path")).agg(F.count("*").alias("large_methods"))
    rows = g.file.filter("total_lines > 10").join(large, "path", "left").fillna(0, ["large_methods"])
    return top(rows.select("path", "total_lines", "method_count", "large_methods", (F.col("total_lines") + F.col("large_methods") * 20).alias("complexity_indicator")), 50, F.desc("complexity_indicator"), "path")


@query("Q52_orchestrators", """
SELECT m.file AS path, m.class_name, m.name, m.method_signature, count(*) AS calls_made, m.estimated_lines,
  CASE WHEN count(*) > 3 THEN 'High Orchestrator' WHEN count(*) > 2 THEN 'Medium Orchestrator' ELSE 'Low Orchestrator' END AS orchestration_level
FROM g_method m JOIN g_calls c ON c.src = m.method_signature GROUP BY 1, 2, 3, 4, 6 HAVING count(*) > 1 ORDER BY calls_made DESC, method_signature LIMIT 30""")  # fmt: skip
def orchestrators(g: Graph, low: int = 1, medium: int = 2, high: int = 3) -> DataFrame:
    made = g.calls.groupBy(F.col("src").alias("method_signature")).agg(F.count("*").alias("calls_made")).filter(F.col("calls_made") > low)
    level = F.when(F.col("calls_made") > high, "High Orchestrator").when(F.col("calls_made") > medium, "Medium Orchestrator").otherwise("Low Orchestrator")
    rows = g.method.join(made, "method_signature").select(F.col("file").alias("path"), "class_name", "name", "method_signature", "calls_made", "estimated_lines", level.alias("orchestration_level"))
    return top(rows, 30, F.desc("calls_made"), "method_signature")


@query("Q53_method_sizes", """
SELECT CASE WHEN estimated_lines <= 10 THEN 'Simple (1-10 lines)' WHEN estimated_lines <= 30 THEN 'Medium (11-30 lines)' WHEN estimated_lines <= 100 THEN 'Complex (31-100 lines)' ELSE 'Very Complex (100+ lines)' END AS complexity_category,
  count(*) AS method_count, avg(estimated_lines) AS avg_lines, max(estimated_lines) AS max_lines FROM g_method WHERE estimated_lines > 0 GROUP BY 1""")  # fmt: skip
def method_sizes(g: Graph) -> DataFrame:
    n = F.col("estimated_lines")
    kind = F.when(n <= 10, "Simple (1-10 lines)").when(n <= 30, "Medium (11-30 lines)").when(n <= 100, "Complex (31-100 lines)").otherwise("Very Complex (100+ lines)")
    return g.method.filter(n > 0).groupBy(kind.alias("complexity_category")).agg(F.count("*").alias("method_count"), F.avg(n).alias("avg_lines"), F.max(n).alias("max_lines"))


@query("Q54_unused_methods", """
SELECT file AS path, coalesce(class_name, 'Unknown') AS class_name, name, method_signature, estimated_lines, CASE WHEN is_static THEN 'Static' ELSE 'Instance' END AS method_type
FROM g_method m WHERE NOT EXISTS (SELECT 1 FROM g_calls c WHERE c.dst = m.method_signature) AND NOT is_public AND name <> 'main' AND name NOT LIKE 'test%' ORDER BY estimated_lines DESC, method_signature LIMIT 50""")  # fmt: skip
def unused_methods(g: Graph) -> DataFrame:
    rows = g.method.filter("not is_public and name <> 'main' and not startswith(name, 'test')").join(g.calls.select(F.col("dst").alias("method_signature")), "method_signature", "left_anti")
    kind = F.when(F.col("is_static"), "Static").otherwise("Instance").alias("method_type")
    rows = rows.select(F.col("file").alias("path"), F.coalesce("class_name", F.lit("Unknown")).alias("class_name"), "name", "method_signature", "estimated_lines", kind)
    return top(rows, 50, F.desc("estimated_lines"), "method_signature")


@query("Q55_class_hierarchy", """
WITH RECURSIVE r(node, up, n) AS (
  SELECT child_id, parent_id, 1 FROM g_extends UNION ALL SELECT r.node, e.parent_id, n + 1 FROM r JOIN g_extends e ON e.child_id = r.up WHERE n < 5),
x AS (SELECT t.file AS path, t.name, t.cid, (SELECT count(DISTINCT up) FROM r WHERE r.node = t.cid) AS ancestors, (SELECT count(DISTINCT node) FROM r WHERE r.up = t.cid) AS descendants FROM g_type t)
SELECT path, name, cid, ancestors, descendants, ancestors + descendants AS involvement,
  CASE WHEN ancestors > 3 THEN 'Deep Inheritance' WHEN descendants > 5 THEN 'Wide Inheritance' WHEN ancestors = 0 AND descendants = 0 THEN 'Standalone' ELSE 'Standard' END AS pattern
FROM x ORDER BY involvement DESC, cid LIMIT 30""")  # fmt: skip
def class_hierarchy(g: Graph) -> DataFrame:
    a = ancestors(g.extends.select(F.col("child_id").alias("child"), F.col("parent_id").alias("parent")), 5)
    up = a.groupBy(F.col("node").alias("cid")).agg(F.count("*").alias("ancestors"))
    down = a.groupBy(F.col("ancestor").alias("cid")).agg(F.count("*").alias("descendants"))
    rows = g.type.join(up, "cid", "left").join(down, "cid", "left").fillna(0, ["ancestors", "descendants"])
    pattern = F.when(F.col("ancestors") > 3, "Deep Inheritance").when(F.col("descendants") > 5, "Wide Inheritance")
    pattern = pattern.when((F.col("ancestors") == 0) & (F.col("descendants") == 0), "Standalone").otherwise("Standard")
    rows = rows.select(F.col("file").alias("path"), "name", "cid", "ancestors", "descendants", (F.col("ancestors") + F.col("descendants")).alias("involvement"), pattern.alias("pattern"))
    return top(rows, 30, F.desc("involvement"), "cid")


@query("Q56_overview", """
SELECT (SELECT count(*) FROM g_file) AS total_files, (SELECT cast(sum(total_lines) AS bigint) FROM g_file) AS total_lines_of_code, (SELECT count(*) FROM g_method) AS total_methods,
  (SELECT count(*) FROM g_type) AS total_classes, (SELECT count(*) FROM g_interface) AS total_interfaces, (SELECT count(*) FROM g_dependency) AS external_dependencies,
  (SELECT count(*) FROM g_cve) AS total_cves, (SELECT avg(total_lines) FROM g_file) AS avg_file_size""")  # fmt: skip
def overview(g: Graph) -> DataFrame:
    # scalar aggregates side by side: each side of these joins is one row
    out = g.file.agg(F.count("*").alias("total_files"), F.sum("total_lines").alias("total_lines_of_code"), F.avg("total_lines").alias("avg_file_size"))
    for name, table in (("total_methods", g.method), ("total_classes", g.type), ("total_interfaces", g.interface), ("external_dependencies", g.dependency), ("total_cves", g.cve)):
        out = out.join(table.agg(F.count("*").alias(name)))
    return out
