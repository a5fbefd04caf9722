"""Histories: co-change, owners, experts, churn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskgraph.catalog import AS_OF, Graph
from riskgraph.operators import history
from riskgraph.plans.architecture import EXPOSED
from riskgraph.plans.registry import query, top

NOW = f"TIMESTAMP '{AS_OF}'"
PAIRS = """t AS (SELECT DISTINCT sha, path FROM g_changed), n AS (SELECT path, count(*) AS n FROM t GROUP BY 1),
p AS (SELECT a.path AS path1, b.path AS path2, count(*) AS support FROM t a JOIN t b ON a.sha = b.sha AND a.path < b.path GROUP BY 1, 2 HAVING count(*) >= 5),
cc AS (SELECT path1, path2, support, (support / x.n + support / y.n) / 2.0::DOUBLE AS confidence FROM p JOIN n x ON x.path = path1 JOIN n y ON y.path = path2)"""
FILE = "src/m3/F13.java"


def pairs(g: Graph) -> DataFrame:
    return history.co_changes(g.changed, g.commit, 5)


query("C10_co_change", f"WITH {PAIRS} SELECT * FROM cc")(pairs)
query("Q68_co_change_read", f"WITH {PAIRS} SELECT path1 AS file1, path2 AS file2, support, confidence FROM cc WHERE confidence >= 0.02")(
    lambda g: history.co_changes(g.changed, g.commit, 5, 0.02).select(F.col("path1").alias("file1"), F.col("path2").alias("file2"), "support", "confidence")
)
query("Q13_co_change_pairs", f"WITH {PAIRS} SELECT path1 AS f1, path2 AS f2, support, confidence FROM cc WHERE confidence >= 0.01 ORDER BY support DESC, path1, path2 LIMIT 25")(
    lambda g: top(history.co_changes(g.changed, g.commit, 5, 0.01).select(F.col("path1").alias("f1"), F.col("path2").alias("f2"), "support", "confidence"), 25, F.desc("support"), "f1", "f2")
)
query("Q37_top_coupling", f"WITH {PAIRS} SELECT path1, path2, support, confidence FROM cc ORDER BY support DESC, path1, path2 LIMIT 20")(lambda g: top(pairs(g), 20, F.desc("support"), "path1", "path2"))
query("Q25_file_blast_radius", f"WITH {PAIRS} SELECT CASE WHEN path1 = '{FILE}' THEN path2 ELSE path1 END AS co_changed_file, support AS times_changed_together FROM cc WHERE path1 = '{FILE}' OR path2 = '{FILE}' ORDER BY 2 DESC, 1 LIMIT 20")(
    lambda g: top(history.partners_of(g.changed, g.commit, g.file.filter(F.col("path") == FILE)).select(F.col("partner").alias("co_changed_file"), F.col("support").alias("times_changed_together")), 20, F.desc("times_changed_together"), "co_changed_file")
)
query("C5_partners", f"WITH {PAIRS} SELECT path1 AS path, path2 AS partner, support FROM cc UNION ALL SELECT path2, path1, support FROM cc")(lambda g: history.partners(pairs(g)).drop("confidence"))

_OWN = "SELECT c.author_email AS email, h.path, count(DISTINCT h.sha) AS commits, max(c.date) AS last_touched FROM g_changed h JOIN g_commit c ON c.sha = h.sha GROUP BY 1, 2"


def per_author(g: Graph) -> DataFrame:
    return g.authored_changes.groupBy("email", "path").agg(F.count_distinct("sha").alias("commits"), F.max("date").alias("last_touched"))


def commits_of_authors(g: Graph) -> DataFrame:
    """Commits by file and author as commits name them, so that developers listed more than once do not multiply the rows."""
    rows = g.changed.select("sha", "path").distinct().join(g.commit.select("sha", F.col("author_email").alias("email")).distinct(), "sha")
    return rows.groupBy("path", "email").agg(F.count("*").alias("commits"))


query("Q26_file_owners", f"WITH o AS ({_OWN}) SELECT email AS developer, email, commits, last_touched FROM o WHERE path = '{FILE}' ORDER BY commits DESC, email LIMIT 5")(
    lambda g: top(per_author(g).filter(F.col("path") == FILE).select(F.col("email").alias("developer"), "email", "commits", "last_touched"), 5, F.desc("commits"), "email")
)
query("C5_committers", f"WITH o AS ({_OWN}) SELECT path, email, commits, last_touched FROM o")(lambda g: per_author(g).select("path", "email", "commits", "last_touched"))
query("G13_bus_factor", f"""WITH o AS ({_OWN}), k AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY commits DESC, email) AS k, sum(commits) OVER (PARTITION BY path ORDER BY commits DESC, email ROWS UNBOUNDED PRECEDING) AS cum,
  sum(commits) OVER (PARTITION BY path) AS total FROM o) SELECT path, cast(min(k) AS int) AS bus_factor FROM k WHERE cum * 2 >= total GROUP BY 1""")(lambda g: history.bus_factor(per_author(g), "path"))  # fmt: skip
_EXPERTS = f"SELECT email, count(*) AS files_touched, cast(sum(commits) AS bigint) AS total_commits {{more}} FROM ({_OWN}) WHERE path LIKE '%m3/%' AND commits >= 1 GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10"


def experts(g: Graph, module: str = "m3/", least: int = 1) -> DataFrame:
    rows = per_author(g).filter(F.col("path").contains(module) & (F.col("commits") >= least))
    return rows.groupBy("email").agg(F.count("*").alias("files_touched"), F.sum("commits").alias("total_commits"), F.array_join(F.slice(F.sort_array(F.collect_list("path")), 1, 5), ",").alias("key_files"))


query("Q17_experts", _EXPERTS.format(more=""))(lambda g: top(experts(g).drop("key_files"), 10, F.desc("total_commits"), "email"))
query("Q45_expertise_map", _EXPERTS.format(more=", list_aggregate(list_slice(list_sort(list(path)), 1, 5), 'string_agg', ',') AS key_files"))(lambda g: top(experts(g), 10, F.desc("total_commits"), "email"))
query("Q18_churn", "SELECT path, count(*) AS changes, cast(sum(additions) AS bigint) AS adds, cast(sum(deletions) AS bigint) AS dels, cast(sum(additions + deletions) AS bigint) AS churn FROM g_changed GROUP BY 1 ORDER BY churn DESC, path LIMIT 25")(
    lambda g: top(
        g.changed.fillna(0, ["additions", "deletions"]).groupBy("path").agg(F.count("*").alias("changes"), F.sum("additions").alias("adds"), F.sum("deletions").alias("dels"), F.sum(F.col("additions") + F.col("deletions")).alias("churn")),
        25, F.desc("churn"), "path",
    )
)


@query("Q14_release_risk", f"""
WITH r AS (SELECT h.path, count(*) AS recent_changes FROM g_changed h JOIN g_commit c ON c.sha = h.sha WHERE c.date > {NOW} - INTERVAL 90 DAYS GROUP BY 1),
v AS (SELECT i.path, count(DISTINCT c.id) AS risks FROM {EXPOSED} WHERE c.cvss_score >= 9.0 GROUP BY 1), m AS (SELECT file, count(*) AS n FROM g_method WHERE is_public GROUP BY 1)
SELECT r.path, recent_changes, coalesce(risks, 0) AS security_risks, coalesce(n, 0) AS public_api_methods,
  CASE WHEN coalesce(risks, 0) > 0 AND coalesce(n, 0) > 0 THEN 'HIGH RISK' WHEN coalesce(risks, 0) > 0 OR recent_changes > 10 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS release_risk_level
FROM r LEFT JOIN v ON v.path = r.path LEFT JOIN m ON m.file = r.path""")  # fmt: skip
def release_risk(g: Graph) -> DataFrame:
    recent = g.changed.join(g.commit.filter(history.since(90)).select("sha"), "sha").groupBy("path").agg(F.count("*").alias("recent_changes"))
    risks = g.exposure.filter("cvss_score >= 9.0").groupBy("path").agg(F.count_distinct("cve_id").alias("security_risks"))
    api = g.method.filter("is_public").groupBy(F.col("file").alias("path")).agg(F.count("*").alias("public_api_methods"))
    rows = recent.join(risks, "path", "left").join(api, "path", "left").fillna(0)
    risky, open_ = F.col("security_risks") > 0, F.col("public_api_methods") > 0
    return rows.withColumn("release_risk_level", F.when(risky & open_, "HIGH RISK").when(risky | (F.col("recent_changes") > 10), "MEDIUM RISK").otherwise("LOW RISK"))


@query("Q27_exposed_owner_radius", f"""
WITH {PAIRS}, o AS ({_OWN}), x AS (SELECT DISTINCT c.id AS cve, a.dep_id, i.path FROM {EXPOSED} WHERE c.cvss_score >= 9.0),
w AS (SELECT path, email FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY commits DESC, email) AS k FROM o) WHERE k = 1),
b AS (SELECT path, count(*) AS n FROM (SELECT path1 AS path FROM cc UNION ALL SELECT path2 FROM cc) GROUP BY 1)
SELECT x.cve, x.dep_id, x.path AS exposed_file, w.email AS top_owner, coalesce(b.n, 0) AS blast_radius FROM x JOIN w ON w.path = x.path LEFT JOIN b ON b.path = x.path ORDER BY blast_radius DESC, 1, 2, 3 LIMIT 25""")  # fmt: skip
def exposed_owner_radius(g: Graph) -> DataFrame:
    exposed = g.exposure.filter("cvss_score >= 9.0").select(F.col("cve_id").alias("cve"), "dep_id", "path").distinct()
    owner = per_author(g).groupBy("path").agg(F.min(F.struct(-F.col("commits"), "email")).alias("o")).select("path", F.col("o.email").alias("top_owner"))
    radius = history.partners_of(g.changed, g.commit, exposed.select("path")).groupBy("path").agg(F.count("*").alias("blast_radius"))
    rows = exposed.join(owner, "path").join(radius, "path", "left").fillna(0, ["blast_radius"])
    return top(rows.select("cve", "dep_id", F.col("path").alias("exposed_file"), "top_owner", "blast_radius"), 25, F.desc("blast_radius"), "cve", "dep_id", "exposed_file")


query("Q40_top_contributors", "SELECT author_email AS email, count(*) AS commits FROM g_commit GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda g: top(g.commit.groupBy(F.col("author_email").alias("email")).agg(F.count("*").alias("commits")), 10, F.desc("commits"), "email"))
query("Q41_single_owner", f"WITH o AS ({_OWN}) SELECT path FROM o GROUP BY 1 HAVING count(*) = 1")(lambda g: per_author(g).groupBy("path").agg(F.count("*").alias("n")).filter("n = 1").select("path"))


@query("Q49_team_coordination", f"""
WITH {PAIRS}, d AS (SELECT DISTINCT h.path, c.author_email AS email FROM g_changed h JOIN g_commit c ON c.sha = h.sha), s AS (SELECT * FROM cc ORDER BY support DESC, path1, path2 LIMIT 25)
SELECT s.path1, s.path2, s.support, list_aggregate(list_slice(list_sort(list(DISTINCT a.email)), 1, 3), 'string_agg', ',') AS f1_developers, list_aggregate(list_slice(list_sort(list(DISTINCT b.email)), 1, 3), 'string_agg', ',') AS f2_developers
FROM s JOIN d a ON a.path = s.path1 JOIN d b ON b.path = s.path2 AND a.email <> b.email GROUP BY 1, 2, 3""")  # fmt: skip
def team_coordination(g: Graph) -> DataFrame:
    """The strongest pairs with developers of either file who meet another one at the other file.

    A developer of one file counts if the other file has anyone else; that is a count, so
    developers are never paired.
    """
    strongest = top(pairs(g), 25, F.desc("support"), "path1", "path2").select("path1", "path2", "support")
    people = g.authored_changes.select("path", "email").distinct()
    many = people.groupBy("path").agg(F.count("*").alias("n"), F.min("email").alias("sole"))
    out = strongest
    for mine, other, name in (("path1", "path2", "f1_developers"), ("path2", "path1", "f2_developers")):
        rows = strongest.join(people.withColumnRenamed("path", mine), mine).join(many.withColumnRenamed("path", other), other).filter("n > 1 or sole <> email")
        rows = rows.withColumn("k", F.row_number().over(W.partitionBy("path1", "path2").orderBy("email"))).filter("k <= 3")
        out = out.join(rows.groupBy("path1", "path2").agg(F.array_join(F.sort_array(F.collect_list("email")), ",").alias(name)), ["path1", "path2"])
    return out


query("Q50_recent_impact", f"""SELECT f.path, count(DISTINCT h.sha) AS recent_changes, f.total_lines, f.method_count, count(DISTINCT h.sha) * f.total_lines / 1000.0::DOUBLE AS change_impact_score FROM g_changed h JOIN g_commit c ON c.sha = h.sha
  JOIN g_file f ON f.path = h.path WHERE c.date > {NOW} - INTERVAL 90 DAYS GROUP BY f.path, f.total_lines, f.method_count HAVING count(DISTINCT h.sha) >= 3 ORDER BY change_impact_score DESC, 1 LIMIT 50""")(  # fmt: skip
    lambda g: top(
        history.recent_changes(g, 90).filter("change_count >= 3").join(g.file, "path")
        .select("path", F.col("change_count").alias("recent_changes"), "total_lines", "method_count", (F.col("change_count") * F.col("total_lines") / 1000.0).alias("change_impact_score")), 50, F.desc("change_impact_score"), "path"
    )
)
query("Q57_file_provenance", f"SELECT c.author_email AS author, c.sha, c.date FROM g_changed h JOIN g_commit c ON c.sha = h.sha WHERE h.path = '{FILE}' ORDER BY c.date DESC, c.sha LIMIT 20")(
    lambda g: top(g.changed.filter(F.col("path") == FILE).join(g.commit, "sha").select(F.col("author_email").alias("author"), "sha", "date"), 20, F.desc("date"), "sha")
)


@query("Q60_vulnerable_file_committers", f"""
WITH o AS ({_OWN}),
x AS (SELECT DISTINCT c.id, a.dep_id, i.path FROM g_imports i JOIN g_depends_on d ON d.import_path = i.import_path JOIN g_affects a ON a.dep_id = d.dep_id JOIN g_cve c ON c.id = a.cve_id WHERE c.cvss_score >= 7.0)
SELECT x.id AS vulnerability, x.dep_id, x.path AS file_path, o.email, o.commits AS expertise_level FROM x JOIN o ON o.path = x.path ORDER BY 5 DESC, 1, 2, 3, 4 LIMIT 100""")  # fmt: skip
def vulnerable_file_committers(g: Graph, most: int = 100) -> DataFrame:
    """The first ``most`` rows of all vulnerabilities, dependencies, files and committers, in order of commits.

    The rows of a file are all its exposures times all its committers. A committer, or an
    exposure, that stands behind ``most`` others of its file has as many rows before each of
    its own, so none of them is among the first; without these the product is small.
    """
    severe = g.cve.filter("cvss_score >= 7.0").select(F.col("id").alias("cve_id"))
    files = severe.join(g.affects, "cve_id").join(g.file_dependency, "dep_id").select("path", F.col("cve_id").alias("vulnerability"), "dep_id").distinct()
    people = commits_of_authors(g).select("path", "email", F.col("commits").alias("expertise_level"))
    first = lambda df, *order: df.withColumn("k", F.row_number().over(W.partitionBy("path").orderBy(*order))).filter(F.col("k") <= most).drop("k")
    rows = first(files, "vulnerability", "dep_id").join(first(people, F.desc("expertise_level"), "email"), "path")
    rows = rows.select("vulnerability", "dep_id", F.col("path").alias("file_path"), "email", "expertise_level")
    return top(rows, most, F.desc("expertise_level"), "vulnerability", "dep_id", "file_path", "email")


_DEEP = f"""x AS (SELECT DISTINCT i.path, a.dep_id FROM {EXPOSED} WHERE c.id = 'CVE-2024-0007'), o AS ({_OWN}),
d AS (SELECT x.path AS vulnerable_file, x.dep_id, f.total_lines AS complexity, count(*) AS developer_count, count(*) FILTER (o.commits >= 3) AS experts, count(*) FILTER (o.last_touched > {NOW} - INTERVAL 90 DAYS) AS recent_contributors
FROM x JOIN g_file f ON f.path = x.path JOIN o ON o.path = x.path GROUP BY 1, 2, 3)"""


def deep_dive(g: Graph, cve: str = "CVE-2024-0007", least: int = 3, days: int = 90) -> DataFrame:
    """Per file exposed to a vulnerability: how many developers, experts, and recent contributors it has."""
    files = g.exposure.filter(F.col("cve_id") == cve).select("path", "dep_id").distinct().join(g.file, "path")
    people = per_author(g).withColumn("date", F.col("last_touched"))
    sums = people.groupBy("path").agg(F.count("*").alias("developer_count"), F.count_if(F.col("commits") >= least).alias("experts"), F.count_if(history.since(days)).alias("recent_contributors"))
    return files.join(sums, "path").select(F.col("path").alias("vulnerable_file"), "dep_id", F.col("total_lines").alias("complexity"), "developer_count", "experts", "recent_contributors")


query("Q62_deep_dive", f"WITH {_DEEP} SELECT * FROM d")(deep_dive)
query("Q63_deep_dive_experts", f"WITH {_DEEP} SELECT experts, recent_contributors, vulnerable_file FROM d")(lambda g: deep_dive(g).select("experts", "recent_contributors", "vulnerable_file"))


@query("Q64_developer_exposure", f"""
WITH c100 AS (SELECT * FROM g_cve WHERE cvss_score >= 6.0 ORDER BY cvss_score DESC, id LIMIT 100),
x AS (SELECT i.path, max(c.cvss_score) AS worst FROM g_imports i JOIN g_depends_on d ON d.import_path = i.import_path JOIN g_affects a ON a.dep_id = d.dep_id JOIN c100 c ON c.id = a.cve_id GROUP BY 1)
SELECT m.author_email AS email, count(DISTINCT h.path) AS files, max(x.worst) AS max_severity, count(DISTINCT h.sha) AS expertise_level FROM g_changed h JOIN x ON x.path = h.path JOIN g_commit m ON m.sha = h.sha
GROUP BY 1 HAVING count(DISTINCT h.sha) >= 2 ORDER BY 4 DESC, 1 LIMIT 50""")  # fmt: skip
def developer_exposure(g: Graph) -> DataFrame:
    worst = top(g.cve.filter("cvss_score >= 6.0"), 100, F.desc("cvss_score"), "id").select(F.col("id").alias("cve_id"), "cvss_score")
    files = worst.join(g.affects, "cve_id").join(g.file_dependency, "dep_id").groupBy("path").agg(F.max("cvss_score").alias("worst"))
    rows = g.authored_changes.join(files, "path").groupBy("email").agg(F.count_distinct("path").alias("files"), F.max("worst").alias("max_severity"), F.count_distinct("sha").alias("expertise_level"))
    return top(rows.filter("expertise_level >= 2"), 50, F.desc("expertise_level"), "email")


@query("Q65_critical_path", f"""
SELECT c.id AS cve_id, c.cvss_score AS severity, count(DISTINCT i.path) AS files_affected, count(DISTINCT r.email) AS developers_involved FROM {EXPOSED}
LEFT JOIN (SELECT DISTINCT h.path, m.author_email AS email FROM g_changed h JOIN g_commit m ON m.sha = h.sha WHERE m.date > {NOW} - INTERVAL 90 DAYS) r ON r.path = i.path WHERE c.cvss_score >= 8.0 GROUP BY 1, 2""")  # fmt: skip
def critical_path(g: Graph) -> DataFrame:
    files = g.exposure.filter("cvss_score >= 8.0").select("cve_id", F.col("cvss_score").alias("severity"), "path").distinct()
    people = g.authored_changes.filter(history.since(90)).select("path", "email").distinct()
    return files.join(people, "path", "left").groupBy("cve_id", "severity").agg(F.count_distinct("path").alias("files_affected"), F.count_distinct("email").alias("developers_involved"))


_HOT = "n * 1.0::DOUBLE + f.method_count / 20.0::DOUBLE + f.total_lines / 1000.0::DOUBLE"


query("Q66_cve_hotspots", f"WITH h AS (SELECT path, count(DISTINCT sha) AS n FROM g_changed GROUP BY 1), x AS (SELECT DISTINCT i.path FROM {EXPOSED} WHERE c.id = 'CVE-2024-0007') SELECT x.path, {_HOT} AS score FROM x JOIN g_file f ON f.path = x.path JOIN h ON h.path = x.path")(
    lambda g: history.hotspots(g, None).join(g.exposure.filter("cve_id = 'CVE-2024-0007'").select("path"), "path", "left_semi").select("path", "score")
)
query("Q69_hotspots", f"WITH h AS (SELECT h.path, count(DISTINCT h.sha) AS n FROM g_changed h JOIN g_commit c ON c.sha = h.sha WHERE c.date > {NOW} - INTERVAL 180 DAYS GROUP BY 1) SELECT f.path, n AS recent_changes, f.method_count, f.total_lines, {_HOT} AS score FROM h JOIN g_file f ON f.path = h.path WHERE n >= 2")(
    lambda g: history.hotspots(g, 180, 2)
)
query("C11_hotspots_top", f"WITH h AS (SELECT h.path, count(DISTINCT h.sha) AS n FROM g_changed h JOIN g_commit c ON c.sha = h.sha WHERE c.date > {NOW} - INTERVAL 180 DAYS GROUP BY 1) SELECT f.path, n AS recent_changes, {_HOT} AS score FROM h JOIN g_file f ON f.path = h.path ORDER BY score DESC, f.path LIMIT 25")(
    lambda g: top(history.hotspots(g, 180, 1).select("path", "recent_changes", "score"), 25, F.desc("score"), "path")
)
query("C7_ownership", f"""WITH o AS (SELECT c.author_email AS email, count(DISTINCT h.sha) AS commits, count(DISTINCT h.path) AS files_touched, max(c.date) AS last_commit FROM g_changed h JOIN g_commit c ON c.sha = h.sha
  WHERE h.path LIKE 'src/m3/%' AND c.date >= {NOW} - INTERVAL 365 DAYS GROUP BY 1) SELECT email, email AS name, commits, files_touched, last_commit, commits / sum(commits) OVER () AS share FROM o""")(  # fmt: skip
    lambda g: history.ownership(g, "src/m3/", 365)
)
query("C9_graph_summary", """SELECT (SELECT count(*) FROM g_file) AS files, (SELECT count(*) FROM g_method) AS methods, (SELECT count(*) FROM g_type) AS classes, (SELECT count(*) FROM g_interface) AS interfaces, (SELECT count(*) FROM g_dependency) AS external_dependencies,
  (SELECT count(*) FROM g_cve) AS cves, (SELECT count(*) FROM g_commit) AS commits, (SELECT count(*) FROM g_developer) AS developers, (SELECT count(*) FROM g_calls) AS calls, (SELECT count(*) FROM g_calls_external) AS calls_external,
  (SELECT count(*) FROM g_imports) AS imports_edges, (SELECT count(*) FROM g_depends_on) AS depends_on, (SELECT count(*) FROM g_affects) AS affects, (SELECT count(*) FROM g_changed) AS changed, (SELECT max(date) FROM g_commit) AS latest_commit""")(  # fmt: skip
    lambda g: graph_summary(g)
)


def graph_summary(g: Graph) -> DataFrame:
    """One row of counts per table and the latest commit; each table is scanned once."""
    tables = {
        "files": g.file, "methods": g.method, "classes": g.type, "interfaces": g.interface, "external_dependencies": g.dependency, "cves": g.cve, "commits": g.commit, "developers": g.developer,
        "calls": g.calls, "calls_external": g.calls_external, "imports_edges": g.imports, "depends_on": g.depends_on, "affects": g.affects, "changed": g.changed,
    }
    out = g.commit.agg(F.max("date").alias("latest_commit"))
    for name, df in tables.items():
        out = out.join(df.agg(F.count("*").alias(name)))
    return out
