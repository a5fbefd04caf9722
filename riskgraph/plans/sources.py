"""Operators of reading, writing and matching, applied to rows made of the graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskgraph.catalog import AS_OF, Graph
from riskgraph.functions import names, versions
from riskgraph.functions.risk import risk_score
from riskgraph.operators import advisories, history, incremental, ladders, matching, reach, writers
from riskgraph.plans import flow
from riskgraph.plans.registry import query
from riskgraph.plans.security import TRIAGE
from riskgraph.plans.team import PAIRS

N = "cast(dep_id AS bigint)"



def _n() -> Column:
    return F.col("dep_id").cast("long")


# -- names and versions ----------------------------------------------------------------------

query("U1_method_signature", "SELECT method_signature AS method, 'com.app.' || substr(file, 5, 2) || '.' || class_name || '#' || name || '(' || CASE arity WHEN 0 THEN '' WHEN 1 THEN 'int' WHEN 2 THEN 'int,?' ELSE 'int,?,?' END || '):' || CASE WHEN is_static THEN 'void' ELSE 'String' END AS signature FROM g_method")(
    lambda g: g.method.select(
        F.col("method_signature").alias("method"),
        names.method_signature(
            F.concat(F.lit("com.app."), F.substring("file", 5, 2)), F.col("class_name"), F.col("name"),
            F.slice(F.array(F.lit("int"), F.lit(None).cast("string"), F.lit(None).cast("string")), F.lit(1), F.col("arity")), F.when(~F.col("is_static"), "String"),
        ).alias("signature"),
    )
)

_TYPED = "CASE dep_id_n % 5 WHEN 0 THEN 'a.b.C<D>' WHEN 1 THEN 'List<X>' WHEN 2 THEN 'Other' WHEN 3 THEN '' ELSE 'Set' END"


def strict_packages(g: Graph) -> DataFrame:
    kind = _n() % 5
    text = F.when(kind == 0, "a.b.C<D>").when(kind == 1, "List<X>").when(kind == 2, "Other").when(kind == 3, "").otherwise("Set")
    explicit = F.create_map(F.lit("List"), F.lit("java.util"))
    wild = F.when(_n() % 2 == 0, F.array(F.lit("org.wild"))).otherwise(F.array(F.lit("org.wild"), F.lit("org.more")))
    found = names.strict_package(text, explicit, wild)
    return g.dependency.select("dep_id", found["package"].alias("package"), found["resolution"].alias("resolution"))


query("U3_strict_package", f"""SELECT dep_id, CASE k WHEN 0 THEN 'a.b' WHEN 1 THEN 'java.util' WHEN 3 THEN NULL ELSE CASE WHEN n % 2 = 0 THEN 'org.wild' END END AS package,
  CASE k WHEN 0 THEN 'fqn' WHEN 1 THEN 'explicit_import' WHEN 3 THEN 'unresolved' ELSE CASE WHEN n % 2 = 0 THEN 'wildcard_import' ELSE 'unresolved' END END AS resolution FROM (SELECT dep_id, {N} AS n, {N} % 5 AS k FROM g_dependency)""")(strict_packages)  # fmt: skip
query("U6_import_kind", f"SELECT dep_id, CASE {N} % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'internal' WHEN 2 THEN 'internal' ELSE 'external' END AS kind FROM g_dependency")(
    lambda g: g.dependency.select("dep_id", names.import_kind(F.when(_n() % 4 == 0, F.concat(F.lit("java.util."), "artifact_id")).when(_n() % 4 == 1, F.concat("group_id", F.lit(".Inner"))).when(_n() % 4 == 2, F.col("group_id")).otherwise(F.concat("group_id", F.lit("x.Other"))), F.col("group_id")).alias("kind"))
)
query("S8_call_kind", f"SELECT dep_id, CASE {N} % 5 WHEN 0 THEN 'same_class' WHEN 1 THEN 'this' WHEN 2 THEN 'super' WHEN 3 THEN 'static' ELSE 'instance' END AS kind FROM g_dependency")(
    lambda g: g.dependency.select("dep_id", names.call_kind(F.get(F.array(F.lit(None).cast("string"), F.lit("this"), F.lit("super"), F.col("artifact_id"), F.lower("artifact_id")), (_n() % 5).cast("int"))).alias("kind"))
)
query("S7_calls_in_code", """SELECT method_signature, 'helper' AS qualifier, 'run' || arity AS name, 'instance' AS kind FROM g_method UNION ALL SELECT method_signature, 'Util', 'go', 'static' FROM g_method UNION ALL SELECT method_signature, NULL, 'plain', 'same_class' FROM g_method""")(
    lambda g: g.method.select("method_signature", F.explode(names.calls_in(F.concat(F.lit("if (x) { for (;;) helper.run"), F.col("arity").cast("string"), F.lit("(1); new Thing(2); Util.go (3); while (plain()) return (4); }")))).alias("c")).select("method_signature", "c.*").filter("name <> 'if'")
)
query("U23_repository_url", f"SELECT dep_id, 'https://host/' || artifact_id AS url FROM g_dependency")(
    lambda g: g.dependency.select("dep_id", names.repository_url(F.concat(F.lit(" https://host/"), "artifact_id", F.when(_n() % 3 == 0, ".git").when(_n() % 3 == 1, "//").otherwise(""), F.lit(" "))).alias("url"))
)
query("S21_coordinate_line", f"SELECT dep_id, CASE WHEN {N} % 4 < 3 THEN group_id END AS group_id, CASE WHEN {N} % 4 < 3 THEN artifact_id END AS artifact_id, CASE WHEN {N} % 4 < 3 THEN version END AS version FROM g_dependency")(
    lambda g: g.dependency.withColumn("c", names.coordinate(F.when(_n() % 4 == 0, F.concat(F.lit("[INFO] +- "), "group_id", F.lit(":"), "artifact_id", F.lit(":jar:"), "version", F.lit(":compile"))).when(_n() % 4 == 1, F.concat(F.lit("|  \\- "), "group_id", F.lit(":"), "artifact_id", F.lit(":jar:sources:"), "version", F.lit(":test")))
    .when(_n() % 4 == 2, F.concat_ws(":", "group_id", "artifact_id", "version")).otherwise(F.concat_ws(":", "group_id", "artifact_id", F.lit("jar"))))).select("dep_id", "c.group_id", "c.artifact_id", "c.version")
)

_KEY = "list_transform(string_split(version, '.'), lambda x: x::INT)"
query("U8_version_in_bounds", f"SELECT dep_id, {_KEY} >= [1, 3, 0] AND {_KEY} < [1, 7, 0] AS closed_open, {_KEY} > [1, 3, 0] AND {_KEY} <= [1, 7, 0] AS open_closed FROM g_dependency")(
    lambda g: g.dependency.select("dep_id", "version").withColumns({
        "closed_open": versions.within("version", F.lit("1.3.0"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("1.7.0")),
        "open_closed": versions.within("version", F.lit(None).cast("string"), F.lit("1.3"), F.lit("1.7"), F.lit("no version!")),
    }).select("dep_id", "closed_open", "open_closed")
)
query("U10_between_swapped", f"SELECT dep_id, {_KEY} >= [1, 2, 0] AND {_KEY} < [1, 6, 0] AS inside FROM g_dependency")(lambda g: g.dependency.select("dep_id", versions.between(F.col("version"), F.lit("1.6"), F.lit("1.2")).alias("inside")))


def range_text() -> Column:
    return F.get(F.array("version", F.concat(F.lit("["), "version", F.lit(",2.0)")), F.concat(F.lit("[ "), "version", F.lit(" ,)")), F.concat(F.lit("(,"), "version", F.lit("]")), F.concat(F.lit("["), "version", F.lit("]"))), (_n() % 5).cast("int"))


query("U9_range_representatives", f"SELECT dep_id, CASE WHEN {N} % 5 = 1 THEN version || '|2.0' ELSE version END AS bounds FROM g_dependency")(lambda g: g.dependency.select("dep_id", F.array_join(versions.representatives(range_text()), "|").alias("bounds")))
query("U14_advisory_range", f"SELECT dep_id, CASE {N} % 3 WHEN 0 THEN '1.0' WHEN 1 THEN version END AS start_including, CASE {N} % 3 WHEN 2 THEN '0.5' END AS start_excluding, CASE {N} % 3 WHEN 1 THEN version WHEN 2 THEN version END AS end_including, CASE {N} % 3 WHEN 0 THEN version END AS end_excluding FROM g_dependency")(
    lambda g: g.dependency.withColumn("r", versions.advisory_range(F.get(F.array(F.concat(F.lit(">= 1.0, < "), "version"), F.concat(F.lit("= "), "version"), F.concat(F.lit("> 0.5 ,<= "), "version")), (_n() % 3).cast("int")))).select("dep_id", "r.*")
)
query("U15_product_of", f"SELECT dep_id, CASE WHEN {N} % 4 = 0 THEN 'apache:log4j' ELSE regexp_extract(group_id, '[^.]*$') || ':' || lower(artifact_id) END AS product FROM g_dependency")(
    lambda g: g.dependency.select("dep_id", versions.product_of(F.when(_n() % 4 == 0, "org.apache.logging.log4j").otherwise(F.col("group_id")), F.when(_n() % 4 == 0, "log4j-core").otherwise(F.col("artifact_id"))).alias("product"))
)
query("U16_relevant", f"SELECT dep_id, {N} % 3 <> 2 AS hit FROM g_dependency")(
    lambda g: g.dependency.select("dep_id", versions.relevant(F.concat(F.lit("flaw in "), F.when(_n() % 3 == 2, "nothing of this").otherwise(F.col("artifact_id")), F.lit(" of vendor")), F.when(_n() % 3 == 0, F.col("artifact_id")).otherwise(F.concat(F.lit("vendor-"), "artifact_id"))).alias("hit"))
)

# -- advisories ------------------------------------------------------------------------------


def raw_advisories(g: Graph) -> DataFrame:
    package = F.struct(F.concat_ws(":", "group_id", "artifact_id").alias("name"), F.when(_n() % 5 == 0, "npm").otherwise("Maven").alias("ecosystem"))
    range_ = F.concat(F.lit(">= 1.0, < "), "version")
    return g.dependency.select(
        F.when(_n() % 3 == 0, "").otherwise(F.concat(F.lit("CVE-D"), "dep_id")).alias("cve_id"), F.concat(F.lit("GHSA-"), "dep_id").alias("ghsa_id"), F.when(_n() % 2 == 1, F.col("artifact_id")).alias("summary"),
        F.col("package").alias("description"), F.lit("high").alias("severity"), F.struct(F.when(_n() % 4 > 0, 7.5).alias("score")).alias("cvss"), F.lit("2024").alias("published_at"), F.lit(None).cast("string").alias("updated_at"),
        F.array(F.struct(package.alias("package"), range_.alias("vulnerable_version_range"))).alias("vulnerabilities"),
    )


query("S24_advisories", f"""SELECT CASE WHEN {N} % 3 = 0 THEN 'GHSA-' ELSE 'CVE-D' END || dep_id AS id, CASE WHEN {N} % 2 = 1 THEN artifact_id ELSE package END AS description, CASE WHEN {N} % 4 > 0 THEN 7.5::DOUBLE ELSE 0.0::DOUBLE END AS cvss_score, 'HIGH' AS severity,
  '2024' AS modified, 'cpe:2.3:a:' || regexp_extract(group_id, '[^.]*$') || ':' || lower(artifact_id) || ':*:*:*:*:*:*:*:*' AS criteria, '1.0' AS start_including, version AS end_excluding FROM g_dependency WHERE {N} % 5 <> 0""")(  # fmt: skip
    lambda g: advisories.advisories_as_cves(raw_advisories(g)).withColumn("m", F.col("configurations")[0]["nodes"][0]["cpeMatch"][0])
    .select("id", "description", "cvss_score", "severity", "modified", "m.criteria", F.col("m.versionStartIncluding").alias("start_including"), F.col("m.versionEndExcluding").alias("end_excluding"))
)


def raw_entries(g: Graph) -> DataFrame:
    n = F.col("n_nationkey")
    metric = F.array(F.struct(F.struct(((n * 7 % 100) / 10.0).alias("baseScore"), F.concat(F.lit("S"), n.cast("string")).alias("baseSeverity")).alias("cvssData")))
    none = F.lit(None).cast("array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>")
    cve = F.struct(
        F.concat(F.lit("CVE-"), (n % 20).cast("string")).alias("id"), F.array(F.struct(F.lit("es").alias("lang"), F.lit("no").alias("value")), F.struct(F.lit("en").alias("lang"), F.col("n_name").alias("value"))).alias("descriptions"),
        F.struct(F.when(n % 2 == 0, metric).otherwise(none).alias("cvssMetricV31"), F.when(n % 3 > 0, metric).otherwise(none).alias("cvssMetricV30")).alias("metrics"), F.lit("2024").alias("published"),
        F.array().cast("array<string>").alias("configurations"),
    )
    return g.source("nation").select(cve.alias("cve"), n.alias("position"))


query("S25_normalised_cves", """WITH e AS (SELECT n_nationkey AS n, 'CVE-' || (n_nationkey % 20) AS id, n_name AS description, CASE WHEN n_nationkey % 2 = 0 OR n_nationkey % 3 > 0 THEN (n_nationkey * 7 % 100)::DOUBLE / 10 ELSE 0 END AS cvss_score FROM nation)
SELECT id, description, cvss_score, 'S' || n AS severity, '2024' AS published FROM e WHERE cvss_score >= 4 AND n = (SELECT min(f.n) FROM e f WHERE f.id = e.id AND f.cvss_score >= 4)""")(  # fmt: skip
    lambda g: matching.normalised_cves(raw_entries(g)).select("id", "description", "cvss_score", "severity", "published")
)


def corporate(g: Graph) -> DataFrame:
    """Dependencies with names long enough to match by: one in ten is a known product."""
    known = _n() % 10 == 0
    return g.dependency.select("dep_id", F.when(known, "org.apache.logging.log4j").otherwise(F.concat(F.lit("com.group"), (_n() % 5).cast("string"))).alias("group_id"), F.when(known, "log4j-core").otherwise(F.lower("artifact_id")).alias("artifact_id"), "version")


def listed_cves(g: Graph) -> DataFrame:
    criteria = F.when(_n() % 7 == 0, "cpe:2.3:a:apache:log_4j2:*").otherwise(F.concat(F.lit("cpe:2.3:a:group"), (_n() % 3).cast("string"), F.lit(":x"), F.lower("artifact_id"), F.lit("_core:*")))
    none = F.lit(None).cast("string")
    match = F.struct(criteria.alias("criteria"), F.lit("1.2").alias("versionStartIncluding"), none.alias("versionStartExcluding"), none.alias("versionEndIncluding"), F.when(_n() % 11 > 0, "1.8").alias("versionEndExcluding"))
    return g.dependency.select(F.concat(F.lit("CVE-D"), "dep_id").alias("id"), F.array(F.struct(F.array(F.struct(F.array(match).alias("cpeMatch"))).alias("nodes"))).alias("configurations"))


query("J13_vulnerable_dependencies", f"""WITH d AS (SELECT dep_id, {N} % 10 = 0 AS known, 'group' || ({N} % 5) AS seg, lower(artifact_id) AS artifact, {_KEY} AS v FROM g_dependency),
c AS (SELECT 'CVE-D' || dep_id AS cve_id, CASE WHEN {N} % 7 = 0 THEN 'cpe:2.3:a:apache:log_4j2:*' ELSE 'cpe:2.3:a:group' || ({N} % 3) || ':x' || lower(artifact_id) || '_core:*' END AS criteria, {N} % 11 > 0 AS bounded FROM g_dependency)
SELECT cve_id, dep_id, CASE WHEN known THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence, CASE WHEN known THEN 'precise_gav' ELSE 'fuzzy' END AS match_type FROM d, c
WHERE v >= [1, 2, 0] AND (NOT bounded OR v < [1, 8, 0]) AND CASE WHEN known THEN contains(replace(replace(criteria, '_', ''), '-', ''), 'apache:log4j') ELSE contains(criteria, artifact) AND contains(criteria, seg) END""")(  # fmt: skip
    lambda g: matching.vulnerable_dependencies(corporate(g), listed_cves(g))
)


def links(g: Graph) -> DataFrame:
    rows = g.affects.join(g.dependency, "dep_id")
    return rows.select("cve_id", F.when(_n() % 3 > 0, F.col("group_id")).otherwise("none").alias("dep_group_id"), F.col("artifact_id").alias("dep_artifact_id"), F.col("package").alias("dep_package"), "confidence", "match_type")


query("J12_affects", f"""WITH l AS (SELECT cve_id, CASE WHEN {N} % 3 > 0 THEN group_id ELSE 'none' END AS gid, artifact_id, package, confidence, match_type FROM g_affects JOIN g_dependency USING (dep_id)),
k AS (SELECT * FROM g_dependency WHERE {N} % 4 > 0)
SELECT DISTINCT cve_id, coalesce(a.dep_id, b.dep_id) AS dep_id, confidence, match_type FROM l LEFT JOIN k a ON a.group_id = l.gid AND a.artifact_id = l.artifact_id LEFT JOIN k b ON b.package = l.package WHERE coalesce(a.dep_id, b.dep_id) IS NOT NULL""")(  # fmt: skip
    lambda g: advisories.affects(links(g), g.dependency.withColumn("version", F.when(_n() % 4 > 0, F.col("version")).when(_n() % 8 > 0, "unknown")))
)

# -- imports, terms, matches by text -----------------------------------------------------------


def imported(g: Graph) -> DataFrame:
    path = F.get(F.array(F.concat("group_id", F.lit(".client.Core.Deep")), F.concat(F.lit("org.slf4j."), "artifact_id"), F.concat(F.lit("net.other.thing.Deep"), "dep_id"), F.concat("group_id", F.lit("9.api.Type"))), (_n() % 4).cast("int"))
    return g.dependency.select(path.alias("import_path"))


_BASES = f"""i AS (SELECT DISTINCT CASE {N} % 4 WHEN 0 THEN group_id || '.client.Core.Deep' WHEN 1 THEN 'org.slf4j.' || artifact_id WHEN 2 THEN 'net.other.thing.Deep' || dep_id ELSE group_id || '9.api.Type' END AS import_path FROM g_dependency),
t AS (SELECT import_path, n, regexp_replace(array_to_string(list_slice(string_split(import_path, '.'), 1, n), '.'), '(\\.[A-Z][^.]*)+$', '') AS base FROM i, (SELECT unnest([5, 4, 3, 2]) AS n) WHERE n <= len(string_split(import_path, '.'))),
k AS (SELECT t.* FROM t WHERE contains(base, '.') AND EXISTS (SELECT 1 FROM g_dependency g WHERE starts_with(g.group_id, base) OR starts_with(base, g.group_id))),
b AS (SELECT import_path, coalesce((SELECT max_by(k.base, k.n) FROM k WHERE k.import_path = i.import_path), array_to_string(list_slice(string_split(import_path, '.'), 1, 3), '.')) AS base FROM i)"""
query("U7_import_bases", f"WITH {_BASES} SELECT import_path, base FROM b")(lambda g: advisories.import_bases(imported(g), g.dependency))
query("U7_coordinates", f"""WITH {_BASES}, m AS (SELECT DISTINCT base, group_id, artifact_id, version, length(group_id) + CASE WHEN contains(lower(artifact_id), lower(regexp_extract(base, '[^.]*$'))) THEN 10 ELSE 0 END AS score
  FROM b JOIN g_dependency g ON starts_with(g.group_id, base) OR starts_with(base, g.group_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY score DESC, group_id, artifact_id, version) AS k FROM m)
SELECT DISTINCT b.base, coalesce(f.group_id, CASE WHEN starts_with(b.base, 'org.slf4j') THEN 'org.slf4j' END) AS group_id, coalesce(f.artifact_id, CASE WHEN starts_with(b.base, 'org.slf4j') THEN 'slf4j-api' END) AS artifact_id, f.version FROM b LEFT JOIN f ON f.base = b.base AND k = 1""")(  # fmt: skip
    lambda g: advisories.coordinates(advisories.import_bases(imported(g), g.dependency), g.dependency)
)
query("W8_missing_dependencies", f"""WITH {_BASES} SELECT base, count(*) AS imports FROM b WHERE NOT EXISTS (SELECT 1 FROM g_dependency g WHERE starts_with(g.group_id, base) OR starts_with(base, g.group_id)) GROUP BY 1""")(
    lambda g: advisories.missing_dependencies(bases := advisories.import_bases(imported(g), g.dependency), advisories.coordinates(bases, g.dependency))
)


def named(g: Graph) -> DataFrame:
    prefix = F.get(F.array(F.lit("com.fasterxml.jackson."), F.lit("org.springframework.data."), F.lit("org.acme.tools."), F.lit("")), (_n() % 4).cast("int"))
    return g.dependency.select(F.concat(prefix, F.lit("Part"), (_n() % 50).cast("string")).alias("name"))


_TERMS = f"""p AS (SELECT DISTINCT lower(CASE {N} % 4 WHEN 0 THEN 'com.fasterxml.jackson.' WHEN 1 THEN 'org.springframework.data.' WHEN 2 THEN 'org.acme.tools.' ELSE '' END || 'Part' || ({N} % 50)) AS name FROM g_dependency),
t AS (SELECT name AS term FROM p UNION SELECT s FROM (SELECT unnest(string_split(name, '.')) AS s FROM p WHERE contains(name, '.')) WHERE s NOT IN ('com', 'org', 'data', 'tools'))"""
query("U17_search_terms", f"WITH {_TERMS} SELECT term FROM t")(lambda g: advisories.search_terms(named(g)))
query("U17_search_queries", f"""WITH {_TERMS}, k AS (SELECT term, CASE WHEN starts_with(term, 'com.fasterxml.jackson.') THEN 'jackson fasterxml' WHEN starts_with(term, 'org.springframework.') THEN 'spring framework' WHEN contains(term, '.') THEN regexp_extract(term, '[^.]*$') ELSE term END AS query FROM t),
f AS (SELECT term, unnest(CASE WHEN contains(term, 'jackson') THEN ['jackson', 'jackson-databind', 'jackson core', 'jackson-core', 'fasterxml jackson-databind', 'fasterxml jackson-core'] WHEN contains(term, 'spring') THEN ['spring'] ELSE [] END) AS query FROM t WHERE contains(term, '.'))
SELECT 'term' AS kind, query, list_aggregate(list_sort(list(DISTINCT term)), 'string_agg', ',') AS terms FROM k GROUP BY 2 UNION ALL SELECT 'family', query, list_aggregate(list_sort(list(DISTINCT term)), 'string_agg', ',') FROM f GROUP BY 2""")(  # fmt: skip
    lambda g: advisories.search_queries(advisories.search_terms(named(g))).select("kind", "query", F.array_join("terms", ",").alias("terms"))
)


def described(g: Graph) -> DataFrame:
    return g.dependency.select(F.concat(F.lit("CVE-D"), "dep_id").alias("id"), F.concat(F.lit("Flaw of "), F.when(_n() % 2 == 0, F.upper("package")).otherwise(F.col("artifact_id")), F.lit(" before 2")).alias("description"))


query("U18_text_matches", f"""WITH c AS (SELECT 'CVE-D' || dep_id AS cve_id, lower('Flaw of ' || CASE WHEN {N} % 2 = 0 THEN upper(package) ELSE artifact_id END || ' before 2') AS text FROM g_dependency)
SELECT cve_id, dep_id, 0.5::DOUBLE AS confidence, 'text_versioned' AS match_type FROM g_dependency, c WHERE contains(text, lower(package)) OR contains(text, lower(regexp_extract(package, '[^.]*$')))""")(lambda g: advisories.text_matches(g.dependency, described(g)))  # fmt: skip


def told(g: Graph) -> DataFrame:
    name = F.concat(F.lit("org.vendor"), (_n() % 3).cast("string"), F.lit(".module-alpha"))
    text = F.get(F.array(F.concat(F.lit("in "), name), F.lit("vendor1 and module-alpha and alpha"), F.lit("some vendor0"), F.lit("nothing")), (_n() % 4).cast("int"))
    return g.dependency.select("dep_id", advisories.text_confidence(name, text).alias("c")).select("dep_id", "c.affected", "c.confidence")


# parts of org.vendorN.module-alpha: vendorN and module-alpha at dots, org.vendorN.module and alpha at the hyphen
query("U19_text_confidence", f"""WITH r AS (SELECT dep_id, {N} % 4 AS k, {N} % 3 AS m FROM g_dependency), h AS (SELECT *, CASE k WHEN 0 THEN 4 WHEN 1 THEN 2 + CASE WHEN m = 1 THEN 1 ELSE 0 END WHEN 2 THEN CASE WHEN m = 0 THEN 1 ELSE 0 END ELSE 0 END AS hits FROM r)
SELECT dep_id, k = 0 OR hits >= 2 AS affected, CASE WHEN k = 0 THEN 0.95::DOUBLE WHEN hits / 4 >= 0.8 THEN 0.8::DOUBLE WHEN hits / 4 >= 0.6 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM h""")(told)  # fmt: skip

# -- tables of parsed files -------------------------------------------------------------------

_CLASS = "struct<name:string,kind:string,line:int,last_line:int,modifiers:array<string>,extends:array<string>,implements:array<string>,enclosing:string,annotations:array<string>>"


def parsed(g: Graph) -> DataFrame:
    """The graph's files as the source reader would give them: types with what they extend, methods with parameters."""
    texts = lambda *c: F.array(*c).cast("array<string>")
    up = g.extends.groupBy(F.col("child").alias("name"), F.col("child_file").alias("file")).agg(F.collect_set("parent").alias("extends"))
    over = g.implements.groupBy(F.col("class_name").alias("name"), F.col("class_file").alias("file")).agg(F.collect_set("interface").alias("implements"))
    under = g.nested.groupBy(F.col("child").alias("name"), F.col("child_file").alias("file")).agg(F.max("parent").alias("enclosing"))
    marks = g.type_annotated.groupBy("name", "file").agg(F.collect_set("annotation").alias("marks"))
    types = g.type.join(up, ["name", "file"], "left").join(over, ["name", "file"], "left").join(under, ["name", "file"], "left").join(marks, ["name", "file"], "left")
    line = (F.col("cid") % 90).cast("int")
    one = F.struct(F.col("name"), F.lit("class").alias("kind"), line.alias("line"), (line + 7).alias("last_line"), texts(F.lit("public")).alias("modifiers"), F.coalesce("extends", texts()).alias("extends"), F.coalesce("implements", texts()).alias("implements"), F.col("enclosing"), F.coalesce("marks", texts()).alias("annotations"))
    faces = F.struct(F.col("name"), F.lit("interface").alias("kind"), F.col("iid").cast("int").alias("line"), (F.col("iid") + 1).cast("int").alias("last_line"), texts().alias("modifiers"), texts().alias("extends"), texts().alias("implements"), F.lit(None).cast("string").alias("enclosing"), texts().alias("annotations"))
    kinds = types.select("file", one.cast(_CLASS).alias("x")).unionByName(g.interface.select("file", faces.cast(_CLASS).alias("x"))).groupBy("file").agg(F.collect_list("x").alias("types"))
    thrown = g.throws.groupBy("method_signature").agg(F.collect_set("exception").alias("throws"))
    marked = g.annotated.groupBy("method_signature").agg(F.collect_set("name").alias("marks"))
    given = g.parameter.groupBy("method_signature").agg(F.collect_list(F.struct(F.col("type"), F.lit("p").alias("name"))).alias("params"))
    methods = g.method.join(thrown, "method_signature", "left").join(marked, "method_signature", "left").join(given, "method_signature", "left")
    start = (F.col("id") % 1000).cast("int")
    head = F.struct(
        F.concat("name", F.lit("_"), "method_signature").alias("name"), F.col("class_name").alias("owner"), start.alias("line"), (start + F.col("estimated_lines") - 1).cast("int").alias("last_line"),
        F.filter(texts(F.when(F.col("is_public"), "public"), F.when(F.col("is_static"), "static")), lambda m: m.isNotNull()).alias("modifiers"), F.lit("void").alias("returns"),
        F.coalesce("params", F.array().cast("array<struct<type:string,name:string>>")).alias("params"), F.coalesce("throws", texts()).alias("throws"), F.coalesce("marks", texts()).alias("annotations"),
        F.col("cyclomatic_complexity").cast("int").alias("complexity"), "deprecated",
    )
    field = F.struct("name", F.col("owner_name").alias("owner"), "type", F.lit(1).alias("line"), F.filter(texts(F.when(F.col("is_public"), "public"), F.when(F.col("is_final"), "final")), lambda m: m.isNotNull()).alias("modifiers"), F.when(F.col("autowired"), texts(F.lit("Autowired"))).otherwise(texts()).alias("annotations"))
    bodies = methods.select("file", head.alias("x")).groupBy("file").agg(F.collect_list("x").alias("methods"))
    fields = g.field.select("file", field.alias("x")).groupBy("file").agg(F.collect_list("x").alias("fields"))
    rows = g.file.select(F.col("path").alias("file"), F.concat(F.lit("com.app."), F.substring("path", 5, 2)).alias("package")).join(kinds, "file", "left").join(bodies, "file", "left").join(fields, "file", "left")
    empty = lambda name, of: F.coalesce(name, F.array().cast(of.schema[name].dataType))
    imports = F.array().cast("array<struct<import_path:string,is_static:boolean,is_wildcard:boolean>>")
    return writers.scoped(rows.select(F.col("file").alias("path"), "package", empty("types", kinds).alias("types"), empty("methods", bodies).alias("methods"), empty("fields", fields).alias("fields"), imports.alias("imports")))


query("W3_types", "SELECT name, file, package, 8 AS estimated_lines FROM g_type")(lambda g: writers.type_tables(parsed(g))["type"].select("name", "file", "package", "estimated_lines"))
query("W3_packages", "SELECT 'com.app.' || substr(file, 5, 2) AS package FROM (SELECT file FROM g_type UNION SELECT file FROM g_interface) GROUP BY 1")(lambda g: writers.type_tables(parsed(g))["package"])
query("W11_type_annotations", "SELECT name, file, annotation FROM g_type_annotated")(lambda g: writers.type_tables(parsed(g))["type_annotated"].select("name", "file", "annotation"))
query("W13_nested", "SELECT child, child_file, max(parent) AS parent FROM g_nested n WHERE EXISTS (SELECT 1 FROM g_type t WHERE t.file = child_file AND t.name = (SELECT max(parent) FROM g_nested o WHERE o.child = n.child AND o.child_file = n.child_file)) GROUP BY 1, 2")(
    lambda g: writers.type_tables(parsed(g))["nested"].select("child", "child_file", "parent")
)


def ladder_sql(refs: str, targets: str) -> str:
    """Text of the three rungs over refs(ref, name, package, file) and targets(name, package, file)."""
    return f"""r AS ({refs}), t AS (SELECT DISTINCT name, package, file FROM ({targets})),
a AS (SELECT ref, t.name, t.file, 1 AS rung FROM r JOIN t ON t.name = r.name AND t.package = r.package UNION ALL SELECT ref, t.name, t.file, 2 FROM r JOIN t ON t.name = r.name AND t.file = r.file
  UNION ALL SELECT ref, t.name, t.file, 3 FROM r JOIN t ON t.name = r.name WHERE (SELECT count(*) FROM (SELECT DISTINCT u.name, u.file FROM t u) u WHERE u.name = r.name) = 1),
found AS (SELECT DISTINCT ref, name, file FROM a WHERE rung = (SELECT min(rung) FROM a b WHERE b.ref = a.ref))"""


_PACKAGE = "'com.app.' || substr(file, 5, 2)"
_FACES = f"SELECT name, {_PACKAGE} AS package, file FROM g_interface"
query("J5_implements_written", f"""WITH {ladder_sql(f"SELECT class_name || '@' || class_file || '@' || interface AS ref, interface AS name, 'com.app.' || substr(class_file, 5, 2) AS package, class_file AS file FROM g_implements", _FACES)}
SELECT split_part(ref, '@', 1) AS class_name, split_part(ref, '@', 2) AS class_file, name AS interface, file AS interface_file FROM found""")(lambda g: writers.type_tables(parsed(g))["implements"])  # fmt: skip
query("J3_extends_written", f"""WITH {ladder_sql("SELECT child || '@' || child_file || '@' || parent AS ref, parent AS name, 'com.app.' || substr(child_file, 5, 2) AS package, child_file AS file FROM g_extends", "SELECT name, package, file FROM g_type")}
SELECT split_part(ref, '@', 1) AS child, split_part(ref, '@', 2) AS child_file, name AS parent, file AS parent_file FROM found""")(  # fmt: skip
    lambda g: writers.type_tables(parsed(g))["extends"].select("child", "child_file", "parent", "parent_file")
)
query("J4_interface_ladder", f"""WITH {ladder_sql("SELECT iid AS ref, name, CASE WHEN iid % 3 = 0 THEN package ELSE 'none' END AS package, CASE WHEN iid % 2 = 0 THEN file ELSE 'none' END AS file FROM g_interface", "SELECT name, package, file FROM g_interface UNION ALL SELECT name, package || '2', file || '2' FROM g_interface WHERE iid % 5 = 1")} SELECT ref, name, file FROM found""")(
    lambda g: ladders.type_references(
        g.interface.select(F.col("iid").alias("ref"), "name", F.when(F.col("iid") % 3 == 0, F.col("package")).otherwise("none").alias("package"), F.when(F.col("iid") % 2 == 0, F.col("file")).otherwise("none").alias("file")),
        g.interface.select("name", "package", "file").unionByName(g.interface.filter("iid % 5 = 1").select("name", F.concat("package", F.lit("2")).alias("package"), F.concat("file", F.lit("2")).alias("file"))),
    ).select("ref", "target.name", "target.file")
)

_SIG = "'com.app.' || substr(m.file, 5, 2) || '.' || m.class_name || '#' || m.name || '_' || m.method_signature || '(' || coalesce(p.types, '') || '):void'"
_WRITTEN = "g_method m LEFT JOIN (SELECT method_signature, string_agg(type, ',') AS types FROM g_parameter GROUP BY 1) p ON p.method_signature = m.method_signature"


def written_methods(g: Graph) -> dict[str, DataFrame]:
    files = parsed(g)
    kinds = writers.type_tables(files)
    return writers.method_tables(files, kinds["type"], kinds["interface"])


query("W4_methods", f"SELECT {_SIG} AS method_signature, m.class_name, m.file, m.estimated_lines, m.is_public, m.is_static, m.cyclomatic_complexity, m.deprecated, CASE WHEN p.types IS NULL THEN 0 ELSE 1 END AS arity FROM {_WRITTEN}")(
    lambda g: written_methods(g)["method"].select("method_signature", "class_name", "file", "estimated_lines", "is_public", "is_static", "cyclomatic_complexity", "deprecated", "arity")
)
query("J6_of_type_written", f"""WITH {ladder_sql("SELECT m.method_signature AS ref, p.type AS name, 'com.app.' || substr(m.file, 5, 2) AS package, m.file AS file FROM g_parameter p JOIN g_method m ON m.method_signature = p.method_signature", f"SELECT name, package, file FROM g_type UNION ALL {_FACES}")}
SELECT {_SIG} AS method_signature, 0 AS idx, found.name AS type, found.file AS type_file FROM {_WRITTEN} JOIN g_parameter q ON q.method_signature = m.method_signature LEFT JOIN found ON found.ref = m.method_signature""")(  # fmt: skip
    lambda g: written_methods(g)["parameter"].select("method_signature", "idx", "type", "type_file")
)
query("W11_method_annotations", f"SELECT {_SIG} AS method_signature, x.name FROM {_WRITTEN} JOIN g_annotated x ON x.method_signature = m.method_signature")(lambda g: written_methods(g)["annotated"])
query("W12_throws", f"SELECT {_SIG} AS method_signature, x.exception FROM {_WRITTEN} JOIN g_throws x ON x.method_signature = m.method_signature")(lambda g: written_methods(g)["throws"])


# -- calls ------------------------------------------------------------------------------------

_CALLS = """k AS (SELECT c.src || '>' || c.dst AS id, c.src, m.name, CASE WHEN m.id % 3 = 0 THEN 'Unknown' ELSE m.class_name END AS target, CASE WHEN m.id % 4 = 0 THEN NULL ELSE m.arity END AS argc, s.class_name AS owner, CASE WHEN s.id % 2 = 0 THEN s.file ELSE m.file END AS file
  FROM g_calls c JOIN g_method s ON s.method_signature = c.src JOIN g_method m ON m.method_signature = c.dst), f AS (SELECT k.*, m.method_signature AS dst, m.class_name AS m_owner, m.file AS m_file, m.is_static, k.argc IS NULL OR m.arity IS NULL OR k.argc = m.arity AS fits FROM k JOIN g_method m ON m.name = k.name)"""


def call_rows(g: Graph, kind: str) -> DataFrame:
    m = lambda p: g.method.select(*(F.col(c).alias(f"{p}_{c}") for c in ("method_signature", "name", "class_name", "file", "arity", "id"))).hint("merge")
    rows = g.calls.join(m("s"), F.col("src") == F.col("s_method_signature")).join(m("m"), F.col("dst") == F.col("m_method_signature"))
    return rows.select(
        F.concat("src", F.lit(">"), "dst").alias("id"), "src", F.lit(kind).alias("kind"), F.col("m_name").alias("name"), F.when(F.col("m_id") % 3 == 0, "Unknown").otherwise(F.col("m_class_name")).alias("target"),
        F.when(F.col("m_id") % 4 > 0, F.col("m_arity")).alias("argc"), F.col("s_class_name").alias("owner"), F.when(F.col("s_id") % 2 == 0, F.col("s_file")).otherwise(F.col("m_file")).alias("file"),
    )


def callable_methods(g: Graph) -> DataFrame:
    return g.method.select(F.col("method_signature").alias("sig"), "name", F.col("class_name").alias("owner"), "file", "arity", "is_static")


def made_types(g: Graph) -> DataFrame:
    """For each third callee its class is one that the caller makes objects of."""
    return g.calls.join(g.method.hint("merge"), F.col("dst") == F.col("method_signature")).filter("id % 3 = 0").select("src", F.col("class_name").alias("type"), "file").distinct()


_PICK = " SELECT DISTINCT src, dst FROM r WHERE rung = (SELECT min(rung) FROM r q WHERE q.id = r.id)"
query("J8_own_calls", f"WITH {_CALLS}, r AS (SELECT *, CASE WHEN m_owner = target THEN 1 ELSE 2 END AS rung FROM f WHERE fits AND file = m_file AND (m_owner = target OR m_owner = owner)){_PICK}")(
    lambda g: ladders.call_edges(call_rows(g, "this"), callable_methods(g)).select("src", "dst")
)
query("J9_static_calls", f"WITH {_CALLS}, r AS (SELECT *, 1 AS rung FROM f WHERE is_static AND m_owner = target){_PICK}")(lambda g: ladders.call_edges(call_rows(g, "static"), callable_methods(g)).select("src", "dst"))
query("J10_other_calls", f"""WITH {_CALLS}, made AS (SELECT DISTINCT c.src, m.class_name AS type, m.file FROM g_calls c JOIN g_method m ON m.method_signature = c.dst WHERE m.id % 3 = 0),
r AS (SELECT id, src, dst, 1 AS rung FROM f WHERE fits AND m_owner = target UNION ALL SELECT id, src, dst, 2 FROM f WHERE fits AND m_owner = owner AND m_file = file
  UNION ALL SELECT f.id, f.src, f.dst, 3 FROM f JOIN made ON made.src = f.src AND made.type = f.m_owner AND made.file = f.m_file WHERE fits
  UNION ALL SELECT id, src, min(dst), 4 FROM f WHERE fits AND m_file = file GROUP BY 1, 2 HAVING count(DISTINCT dst) = 1){_PICK}""")(  # fmt: skip
    lambda g: ladders.call_edges(call_rows(g, "instance"), callable_methods(g), made_types(g)).select("src", "dst")
)


def created(g: Graph) -> DataFrame:
    """Every callee's class as created by the caller, by package where the callee is of an even number, else by name."""
    rows = g.calls.join(g.method, F.col("dst") == F.col("method_signature"))
    package = F.when(F.col("id") % 2 == 0, F.concat(F.lit("com.app."), F.substring("file", 5, 2))).otherwise("none")
    calls = rows.select(F.concat("src", F.lit(">"), "dst").alias("id"), "src", F.lit("constructor").alias("kind"), F.col("class_name").alias("target"), package.alias("package"), F.lit("none").alias("file"))
    return writers.created_types(calls, g.type)


query("J7_creates", f"""WITH {ladder_sql("SELECT c.src || '>' || c.dst AS ref, m.class_name AS name, CASE WHEN m.id % 2 = 0 THEN 'com.app.' || substr(m.file, 5, 2) ELSE 'none' END AS package, 'none' AS file FROM g_calls c JOIN g_method m ON m.method_signature = c.dst", "SELECT name, package, file FROM g_type")}
SELECT DISTINCT split_part(ref, '>', 1) AS src, name AS type, file FROM found""")(created)  # fmt: skip

# -- upkeep -----------------------------------------------------------------------------------

query("S19_one_scope", f"SELECT group_id, min(artifact_id) AS artifact_id, max_by(scope, w * 1000000 - n) AS scope FROM (SELECT group_id, 'a' AS artifact_id, {N} AS n, CASE {N} % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'compile' ELSE 'runtime' END AS scope, CASE {N} % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END AS w FROM g_dependency) GROUP BY 1")(
    lambda g: matching.one_scope(g.dependency.select("group_id", F.lit("a").alias("artifact_id"), F.get(F.array(F.lit("test"), F.lit("compile"), F.lit("runtime")), (_n() % 3).cast("int")).alias("scope"), _n().alias("position"))).select("group_id", "artifact_id", "scope")
)
query("C18_filled_versions", f"SELECT dep_id, CASE WHEN {N} % 3 = 0 OR {N} % 2 = 0 THEN version END AS version FROM g_dependency")(
    lambda g: flow.with_versions(g.dependency.withColumn("version", F.when(_n() % 3 == 0, F.col("version"))).withColumn("group_id", F.concat("group_id", "dep_id")), g.dependency.filter(_n() % 2 == 0).withColumn("group_id", F.concat("group_id", "dep_id"))).select("dep_id", "version")
)
query("C17_census", "SELECT 'cve' AS kind, (SELECT count(*) FROM g_cve) AS count UNION ALL SELECT 'calls', (SELECT count(*) FROM g_calls) UNION ALL SELECT 'file', (SELECT count(*) FROM g_file) UNION ALL SELECT 'method', (SELECT count(*) FROM g_method)")(
    lambda g: flow.census({n: g.table(f"g_{n}") for n in ("cve", "calls", "file", "method")})
)
query("C15_codebase_dependencies", "SELECT 'java:maven' AS ecosystem, list_aggregate(list_sort(list(DISTINCT name)), 'string_agg', ',') AS names FROM (SELECT package AS name FROM g_dependency UNION SELECT artifact_id FROM g_dependency)")(
    lambda g: flow.codebase_dependencies(g.dependency).select("ecosystem", F.array_join("names", ",").alias("names"))
)
query("I1_changes", f"""WITH d AS (SELECT substr('AMDRCT', cast(({N} % 6) AS int) + 1, 1) AS c, 'old/F' || dep_id || '.java' AS old, CASE WHEN {N} % 6 > 2 THEN 'new/F' || dep_id || CASE WHEN {N} % 5 = 0 THEN '.kt' ELSE '.java' END END AS new FROM g_dependency)
SELECT path, action FROM (SELECT old AS path, 'remove' AS action FROM d WHERE c IN ('D', 'R') UNION SELECT coalesce(new, old), 'extract' FROM d WHERE c IN ('A', 'C', 'M', 'T', 'R')) WHERE path LIKE '%.java'""")(  # fmt: skip
    lambda g: incremental.changes(g.dependency.select(
        F.substring(F.lit("AMDRCT"), (_n() % 6).cast("int") + 1, F.lit(1)).alias("code"), F.concat(F.lit("old/F"), "dep_id", F.lit(".java")).alias("old"),
        F.when(_n() % 6 > 2, F.concat(F.lit("new/F"), "dep_id", F.when(_n() % 5 == 0, ".kt").otherwise(".java"))).alias("new")))
)
query("W22_degrees_written", "SELECT method_signature, (SELECT count(*) FROM g_calls WHERE src = method_signature) AS out_degree, (SELECT count(*) FROM g_calls WHERE dst = method_signature) AS in_degree FROM g_method")(
    lambda g: flow.scored_methods(g.method.withColumn("pagerank", F.lit(0.0)).withColumn("in_degree", F.lit(-1)), g.calls).select("method_signature", "out_degree", "in_degree")
)
query("G12_central_summary", "SELECT 'total_degree' AS measure, class_name, name, method_signature, d AS value FROM (SELECT m.*, ((SELECT count(*) FROM g_calls WHERE src = method_signature) + (SELECT count(*) FROM g_calls WHERE dst = method_signature))::DOUBLE AS d FROM g_method m) ORDER BY d DESC, method_signature LIMIT 1")(
    lambda g: flow.central_summary(flow.scored_methods(g.method, g.calls)).filter("measure = 'total_degree'")
)



query("F21_deleted_files", "SELECT path, CASE WHEN path LIKE 'src/m3/%' THEN 'h1' END AS deleted_at_head, CASE WHEN path NOT LIKE 'src/m3/%' THEN total_lines END AS total_lines FROM g_file")(
    lambda g: incremental.marked_deleted(g.file, g.file.filter(F.startswith(F.col("path"), F.lit("src/m3/"))).select("path", F.lit("remove").alias("action")).unionByName(g.file.filter(F.startswith(F.col("path"), F.lit("src/m4/"))).select("path", F.lit("extract").alias("action"))), "h1").select("path", "deleted_at_head", "total_lines")
)
query("F22_detached_calls", "SELECT c.src, c.dst FROM g_calls c JOIN g_method a ON a.method_signature = c.src JOIN g_method b ON b.method_signature = c.dst WHERE a.file NOT LIKE 'src/m3/%' AND b.file NOT LIKE 'src/m3/%'")(
    lambda g: incremental.detached(g.method, "method_signature", {"calls": (g.calls, ("src", "dst"))}, g.method.filter(F.startswith(F.col("file"), F.lit("src/m3/"))))[1]["calls"]
)
query("D3_schema_faults", "SELECT 'lineitem' AS \"table\", 'repeated key' AS fault, count(*) AS count FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'cve', 'no column label', 1")(
    lambda g: incremental.schema_faults({"lineitem": g.source("lineitem"), "cve": g.cve, "file": g.file}, {"lineitem": ("l_orderkey", "l_linenumber"), "cve": ("id", "label"), "file": ("path",)})
)
query("J19_enriched_links", f"SELECT a.cve_id, a.dep_id, coalesce(c.description, '') AS description, coalesce(c.cvss_score, 0) AS cvss_score, coalesce(c.severity, 'UNKNOWN') AS severity FROM g_affects a LEFT JOIN g_cve c ON c.id = a.cve_id AND c.cvss_score >= 7")(
    lambda g: advisories.enriched(g.affects.select("cve_id", "dep_id"), g.cve.filter("cvss_score >= 7"))
)
query("D4_described_cves", "SELECT id, CASE WHEN description IN ('NATION_3', 'NATION_7') THEN 2 ELSE 1 END AS hits FROM g_cve")(
    lambda g: advisories.found_by_words(g.cve, "Nation 7 nation 3 other").select("id", "hits")
)
query("S22_resolved_versions", f"SELECT group_id, artifact_id, CASE WHEN {N} % 3 = 0 THEN '9' ELSE version END AS version FROM g_dependency WHERE {N} % 3 = 0 OR {N} % 2 = 0")(
    lambda g: matching.filled_versions(g.dependency.filter(_n() % 2 == 0).select("group_id", "artifact_id", "version"), g.dependency.filter(_n() % 3 == 0).select("group_id", "artifact_id", F.lit("9").alias("version")))
)
query("W2_file_directories", "SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM g_file")(lambda g: writers.in_directories(g.file.select("path")))
query("W10_fields", "SELECT owner_name, file, name, type, is_public, is_final, autowired FROM g_field")(lambda g: writers.field_tables(parsed(g))["field"])
query("W9_documents", "SELECT method_signature, class_name, file, text FROM (SELECT m.method_signature, CAST(NULL AS string) AS class_name, m.file, 'of ' || m.method_signature AS text FROM g_method m WHERE m.id % 2 = 0) UNION ALL SELECT NULL, NULL, path, 'lost' FROM g_file")(
    lambda g: writers.documents(commented(g), g.method.select("file", (F.col("id") * 10).cast("int").alias("line"), "method_signature"), g.type.limit(0).select("file", F.lit(0).alias("line"), "name")).select("method_signature", "class_name", "file", "text")
)


def commented(g: Graph) -> DataFrame:
    """Each second method with a comment a line above, and each file with one that stands above nothing."""
    line = (F.col("id") * 10).cast("int")
    above = g.method.filter("id % 2 = 0").select("file", F.struct(F.lit("javadoc").alias("kind"), (line - 2).alias("start_line"), (line - 1).alias("end_line"), F.concat(F.lit("of "), "method_signature").alias("text")).alias("x"))
    lost = g.file.select(F.col("path").alias("file"), F.struct(F.lit("line").alias("kind"), F.lit(3).alias("start_line"), F.lit(3).alias("end_line"), F.lit("lost").alias("text")).alias("x"))
    rows = above.unionByName(lost).groupBy("file").agg(F.collect_list("x").alias("docs"))
    return rows.select(F.col("file").alias("path"), F.lit("").alias("package"), F.lit(1).alias("explicit"), F.lit(1).alias("wildcards"), "docs")


query("W6_external_frontier", """WITH k AS (SELECT method_signature, 'f' || (length(method_signature) % 3) AS file, import_path, method_name, confidence_rank, call_count FROM g_calls_external), n AS (SELECT method_signature AS src, 'org.' || import_path AS import_path, method_name, max(CASE confidence_rank WHEN 3 THEN 3 WHEN 2 THEN 2 ELSE 1 END) AS confidence_rank, count(*) AS call_count FROM k WHERE confidence_rank > 1 GROUP BY 1, 2, 3
  UNION ALL SELECT method_signature, 'org.wild', method_name, 1, count(*) FROM k WHERE confidence_rank = 1 GROUP BY 1, 2, 3) SELECT * FROM n""")(  # fmt: skip
    lambda g: ladders.external_frontier(*outside_calls(g)).select("src", "import_path", "method_name", "confidence_rank", "call_count")
)


def outside_calls(g: Graph) -> tuple[DataFrame, DataFrame]:
    """The graph's external calls as calls of sources, with one explicit import each, or the only wildcard."""
    file = F.concat(F.lit("f"), (F.length("method_signature") % 3).cast("string"))
    rows = g.calls_external.withColumn("file", file)
    low = F.col("confidence_rank") == 1
    calls = rows.select(
        F.col("method_signature").alias("src"), "file", F.when(F.col("confidence_rank") == 3, "static").otherwise("instance").alias("kind"), F.col("method_name").alias("name"),
        F.when(low, "Any").otherwise(F.substring_index("import_path", ".", -1)).alias("target"), F.when(low, "org.wild").otherwise("org.lib").alias("package"), F.when(low, "wildcard_import").otherwise("explicit_import").alias("resolution"),
    )
    imports = rows.select("file", F.concat(F.lit("org."), "import_path").alias("import_path"), F.lit(False).alias("is_wildcard"), F.lit("external").alias("kind")).distinct()
    return calls, imports.unionByName(rows.select("file", F.lit("org.wild").alias("import_path"), F.lit(True).alias("is_wildcard"), F.lit("external").alias("kind")).distinct())


# -- the register with its tie-breaks ------------------------------------------------------------


def risk_report(g: Graph, most: int = 20) -> DataFrame:
    """Vulnerabilities in order of evidence, score, partners of the headline's file, days since its last change, id.

    The headline is the first route of a vulnerability: the surest, then the nearest, then
    the least method.
    """
    reached = reach.hops_from(reach.entries(g), g.calls)
    head = reach.best_evidence(g, reached).join(g.method.select("method_signature", F.col("file").alias("path")), "method_signature", "left")
    wanted = head.select("path").distinct()
    changed = g.changed.join(wanted, "path", "left_semi")
    partners = history.partners_of(g.changed, g.commit, wanted).groupBy("path").agg(F.count("*").alias("co_changed"))
    touched = changed.join(g.commit, "sha").groupBy("path").agg(F.max("date").alias("last_touched"))
    stale = F.greatest(F.floor((F.lit(AS_OF).cast("timestamp").cast("long") - F.col("last_touched").cast("timestamp").cast("long")) / 86400), F.lit(0)).alias("stale_days")
    rows = reach.triage(g, 7.0, reached=reached).join(head, "cve_id", "left").join(partners, "path", "left").join(touched.select("path", stale), "path", "left").fillna(0, ["co_changed", "stale_days"])
    rows = rows.withColumn("score", risk_score(F.col("cvss_score"), F.coalesce("rank", F.lit(0)), F.col("hops")))
    return rows.select("cve_id", "cvss_score", "status", "rank", "hops", "method_signature", "co_changed", "stale_days", "score").orderBy(F.col("rank").isNull(), F.desc("score"), F.desc("co_changed"), F.desc("stale_days"), "cve_id").limit(most)


def numbered(rows: DataFrame) -> DataFrame:
    """A report's rows, few and in order, with their position."""
    order = W.orderBy(F.col("rank").isNull(), F.desc("score"), F.desc("co_changed"), F.desc("stale_days"), "cve_id")
    return rows.withColumn("position", F.row_number().over(order))


query("C12_risk_report", TRIAGE.replace("t AS (SELECT c.id", "u AS (SELECT c.id").replace("AS status FROM t)", "AS status FROM u)").replace("WITH RECURSIVE ", f"WITH RECURSIVE {PAIRS}, ", 1) + """, x AS (SELECT a.cve_id, x.method_signature, max(x.confidence_rank) AS rank, min(l.hops) AS hops FROM g_affects a JOIN g_depends_on d ON d.dep_id = a.dep_id
  JOIN g_calls_external x ON x.import_path = d.import_path JOIN least l ON l.node = x.method_signature GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY rank DESC, hops, method_signature) AS k FROM x), pp AS (SELECT path, count(*) AS co_changed FROM (SELECT path1 AS path FROM cc UNION ALL SELECT path2 FROM cc) GROUP BY 1),
z AS (SELECT c.path, greatest(floor((epoch(TIMESTAMP 'AS_OF') - epoch(max(date_trunc('second', o.date)))) / 86400), 0)::BIGINT AS stale_days FROM g_changed c JOIN g_commit o ON o.sha = c.sha GROUP BY 1),
w AS (SELECT s.cve_id, s.cvss_score, s.status, h.rank, h.hops, h.method_signature, coalesce(pp.co_changed, 0) AS co_changed, coalesce(z.stale_days, 0) AS stale_days,
  s.cvss_score * CASE h.rank WHEN 3 THEN 1.0::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 0.05::DOUBLE END * CASE WHEN h.rank IS NULL THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + 0.15::DOUBLE * h.hops) END AS score
  FROM s LEFT JOIN h ON h.cve_id = s.cve_id AND h.k = 1 LEFT JOIN g_method m ON m.method_signature = h.method_signature LEFT JOIN pp ON pp.path = m.file LEFT JOIN z ON z.path = m.file WHERE s.cvss_score >= 7.0)
SELECT * FROM w ORDER BY rank IS NULL, score DESC, co_changed DESC, stale_days DESC, cve_id LIMIT 20""".replace("AS_OF", AS_OF))(risk_report)  # fmt: skip
