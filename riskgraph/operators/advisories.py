"""Advisories: saved JSON to clean vulnerability rows, links to dependencies, search terms, matches by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.functions import versions as V
from riskgraph.operators.contain import containing
from riskgraph.operators.ladders import ladder

# Words too general to search for, and to match a description by.
GENERIC_TERMS = (
    "com", "org", "net", "io", "www", "github", "api", "apache", "boot", "client", "common", "commons", "core", "data", "engine", "framework", "google",
    "impl", "jakarta", "java", "javax", "lang", "library", "misc", "model", "platform", "plugin", "release", "runtime", "security", "server", "service",
    "spring", "starter", "test", "tools", "util", "utils", "web",
)
GENERIC_PARTS = ("java", "com", "org", "io", "net", "util", "core", "common", "main", "test", "api", "impl", "base")
DOMAINS = ("com", "org", "net", "io")
# Families that are also searched for as a whole, and further queries for one of them.
FAMILIES = ("jackson", "spring", "junit", "mockito", "apache")
FURTHER = {"jackson": ("jackson-databind", "jackson core", "jackson-core", "fasterxml jackson-databind", "fasterxml jackson-core")}
# Packages whose coordinates are named otherwise, the first that fits counts.
COORDINATES = (
    ("com.fasterxml.jackson.core", "com.fasterxml.jackson.core", "jackson-core"),
    ("com.fasterxml.jackson.databind", "com.fasterxml.jackson.core", "jackson-databind"),
    ("com.fasterxml.jackson", "com.fasterxml.jackson.core", None),
    ("com.salesforce.emp", "com.pontusvision.salesforce", "emp-connector"),
    ("org.cometd.", "org.cometd.java", "cometd-java-client"),
    ("org.apache.kafka.clients", "org.apache.kafka", "kafka-clients"),
    ("org.apache.kafka.common", "org.apache.kafka", "kafka-clients"),
    ("org.slf4j", "org.slf4j", "slf4j-api"),
    ("org.springframework.boot.autoconfigure", "org.springframework.boot", "spring-boot-autoconfigure"),
    ("org.springframework.boot", "org.springframework.boot", "spring-boot"),
    ("org.springframework.context", "org.springframework", "spring-context"),
    ("org.springframework.beans", "org.springframework", "spring-beans"),
    ("org.springframework.stereotype", "org.springframework", "spring-context"),
    ("org.springframework.kafka", "org.springframework.kafka", "spring-kafka"),
    ("org.HdrHistogram", "org.hdrhistogram", "HdrHistogram"),
    ("org.opentest4j", "org.opentest4j", "opentest4j"),
    ("org.junitpioneer", "org.junit-pioneer", "junit-pioneer"),
    ("org.s1ck.gdl", "org.s1ck", "gdl"),
)

RAW_BOUNDS = dict(zip(V.BOUNDS, ("versionStartIncluding", "versionStartExcluding", "versionEndIncluding", "versionEndExcluding")))
ADVISORY = (
    "cve_id string, ghsa_id string, summary string, description string, severity string, cvss struct<score:double>, published_at string, updated_at string, "
    "vulnerabilities array<struct<package:struct<name:string,ecosystem:string>,vulnerable_version_range:string>>"
)


def filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def advisories_as_cves(advisories: DataFrame) -> DataFrame:
    """Clean vulnerability rows of advisories with the columns of ``ADVISORY``.

    Only packages of the build tool's registry with a coordinate and a range that bounds
    something count; advisories without an id or without such a package are left out. The
    ranges become criteria lines of the known or derived product. A range may be text or
    an array of texts.
    """
    kind = advisories.schema["vulnerabilities"].dataType.elementType["vulnerable_version_range"].dataType.typeName()
    ranges = (lambda r: r) if kind == "array" else (lambda r: F.array(r))

    def lines(v: Column) -> Column:
        name = v["package"]["name"]
        group, artifact = F.substring_index(name, ":", 1), F.regexp_replace(name, "^[^:]*:", "")
        criteria = F.concat(F.lit("cpe:2.3:a:"), V.product_of(group, artifact), F.lit(":*:*:*:*:*:*:*:*"))
        made = F.transform(F.filter(ranges(v["vulnerable_version_range"]), lambda r: r.isNotNull()), lambda r: V.advisory_range(r))
        made = F.filter(made, lambda b: F.coalesce(*(b[c] for c in V.BOUNDS)).isNotNull())
        return F.transform(made, lambda b: F.struct(F.array(F.struct(criteria.alias("criteria"), *(b[c].alias(n) for c, n in RAW_BOUNDS.items()))).alias("cpeMatch")))

    of_registry = F.filter("vulnerabilities", lambda v: (F.lower(v["package"]["ecosystem"]) == "maven") & v["package"]["name"].contains(":"))
    rows = advisories.select(
        F.trim(filled(F.col("cve_id"), F.col("ghsa_id"))).alias("id"), F.coalesce(filled(F.col("summary"), F.col("description")), F.lit("")).alias("description"),
        F.coalesce("cvss.score", F.lit(0.0)).alias("cvss_score"), F.upper(F.coalesce(filled(F.col("severity")), F.lit("UNKNOWN"))).alias("severity"),
        F.coalesce("published_at", F.lit("")).alias("published"), F.coalesce(filled(F.col("updated_at")), "published_at", F.lit("")).alias("modified"),
        F.flatten(F.transform(of_registry, lines)).alias("nodes"),
    )
    rows = rows.filter((F.length("id") > 0) & (F.size("nodes") > 0))
    return rows.select("id", "description", "cvss_score", "severity", "published", "modified", F.array(F.struct("nodes")).alias("configurations"))


def with_advisories(cves: DataFrame, more: DataFrame) -> DataFrame:
    """Both sources; of an id in both the first source's row stays."""
    cols = [c for c in cves.columns if c in more.columns]
    return cves.select(*cols).unionByName(more.join(cves.select("id").distinct(), "id", "left_anti").select(*cols))


def affects(links: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Edges (cve_id, dep_id, confidence, match_type) of links.

    ``links``: cve_id, dep_group_id, dep_artifact_id, dep_package, confidence, match_type. A
    link meets dependencies of its group and artifact, or, if there are none, of its package;
    those without a known version are not met. Of several links of an edge the surest stays.
    """
    known = dependencies.filter("version is not null and version <> 'unknown'")
    by_name = known.select(F.col("group_id").alias("dep_group_id"), F.col("artifact_id").alias("dep_artifact_id"), "dep_id")
    by_package = known.select(F.col("package").alias("dep_package"), "dep_id")
    rows = links.withColumn("link", F.xxhash64("cve_id", "dep_group_id", "dep_artifact_id", "dep_package", "match_type"))
    met = ladder(rows, "link", [(by_name, ["dep_group_id", "dep_artifact_id"]), (by_package, ["dep_package"])], "dep_id")
    best = F.max(F.struct("confidence", "match_type")).alias("b")
    return met.groupBy("cve_id", "dep_id").agg(best).select("cve_id", "dep_id", "b.confidence", "b.match_type")


def linked(cves: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables cve and affects of clean vulnerability rows: those that match a dependency, and which."""
    from riskgraph.operators.matching import vulnerable_dependencies

    named = dependencies.filter("version is not null and version <> 'unknown' and group_id is not null and artifact_id is not null")
    found = vulnerable_dependencies(named, cves)
    links = found.join(named.select("dep_id", F.col("group_id").alias("dep_group_id"), F.col("artifact_id").alias("dep_artifact_id"), F.col("package").alias("dep_package")), "dep_id").drop("dep_id")
    edges = affects(links, dependencies)
    nodes = cves.join(edges.select(F.col("cve_id").alias("id")).distinct(), "id", "left_semi")
    return nodes.select("id", "description", "cvss_score", "severity", "published"), edges


# -- imports and coordinates ------------------------------------------------------------------


def _leading(text: Column) -> Column:
    """All beginnings of a text, itself included, in lower case."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.substring(F.lower(text), F.lit(1), n))


def _agreeing(names: DataFrame, name: str, groups: DataFrame) -> DataFrame:
    """Rows (name, group): one begins the other, whatever the case."""
    shorter = names.select(name, F.explode(_leading(F.col(name))).alias("key")).join(groups.select("group_id", F.lower("group_id").alias("key")), "key")
    longer = names.select(name, F.lower(name).alias("key")).join(groups.select("group_id", F.explode(_leading(F.col("group_id"))).alias("key")), "key")
    return shorter.select(name, "group_id").unionByName(longer.select(name, "group_id")).distinct()


def import_bases(imports: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (import_path, base): the most segments, five to two, that agree with a known dotted group, else the first three (or two).

    Segments that begin with a capital are class names and are cut off the end.
    """
    parts = F.split("import_path", r"\.")
    rows = imports.select("import_path").distinct().filter(F.size(parts) >= 2)
    taken = rows.withColumn("n", F.explode(F.sequence(F.least(F.size(parts), F.lit(5)), F.lit(2), F.lit(-1))))
    taken = taken.withColumn("base", F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), F.col("n")), "."), r"(\.\p{Lu}[^.]*)+$", "")).filter(F.contains("base", F.lit(".")))
    known = groups.select("group_id").filter(F.contains("group_id", F.lit("."))).distinct()
    good = _agreeing(taken.select("base").distinct(), "base", known).select("base").distinct()
    best = taken.join(good, "base").groupBy("import_path").agg(F.max_by("base", "n").alias("known"))
    return rows.join(best, "import_path", "left").select("import_path", F.coalesce("known", F.array_join(F.slice(parts, 1, 3), ".")).alias("base"))


def coordinates(bases: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Rows (base, group_id, artifact_id, version): the dependency that each package base belongs to.

    A group agrees with a base if one begins the other. The longest group wins, ten signs
    more if the base's last segment is in the artifact, then the least name. Bases without
    such a group go by the fixed coordinates; a version that nothing names is that of the
    longest agreeing group, or null.
    """
    bases = bases.select("base").distinct()
    deps = dependencies.select("group_id", "artifact_id", "version").filter("group_id is not null and artifact_id is not null").distinct()
    met = _agreeing(bases, "base", deps.select("group_id").distinct()).join(deps, "group_id")
    bonus = F.contains(F.lower("artifact_id"), F.lower(F.substring_index("base", ".", -1)))
    score = F.length("group_id") + F.when(bonus, 10).otherwise(0)
    best = met.groupBy("base").agg(F.min_by(F.struct("group_id", "artifact_id", "version"), F.struct(-score, "group_id", "artifact_id", "version")).alias("b"))
    by_group = met.filter("version is not null").groupBy("base").agg(F.min_by("version", F.struct(-F.length("group_id"), "group_id", "artifact_id", "version")).alias("group_version"))
    fixed = F.coalesce(*(F.when(F.startswith(F.col("base"), F.lit(p)), F.struct(F.lit(g).alias("group_id"), F.lit(a).cast("string").alias("artifact_id"))) for p, g, a in COORDINATES))
    out = bases.join(best, "base", "left").join(by_group, "base", "left").withColumn("fixed", F.when(F.col("b").isNull(), fixed))
    pinned = deps.groupBy(F.col("group_id").alias("fixed_group"), F.col("artifact_id").alias("fixed_artifact")).agg(F.min("version").alias("fixed_version"))
    out = out.join(pinned, (F.col("fixed.group_id") == F.col("fixed_group")) & (F.col("fixed.artifact_id") == F.col("fixed_artifact")), "left")
    return out.select(
        "base", F.coalesce("b.group_id", "fixed.group_id").alias("group_id"), F.coalesce("b.artifact_id", "fixed.artifact_id").alias("artifact_id"),
        F.coalesce("b.version", "fixed_version", "group_version").alias("version"),
    )


def missing_dependencies(bases: DataFrame, found: DataFrame) -> DataFrame:
    """Package bases to which no coordinate or version was found, with the number of imports behind each."""
    gone = found.filter("group_id is null or artifact_id is null or version is null").select("base")
    return bases.join(gone, "base", "left_semi").groupBy("base").agg(F.count("*").alias("imports"))


# -- search terms -----------------------------------------------------------------------------


def search_terms(names: DataFrame) -> DataFrame:
    """Distinct terms of names (column name): the names, and of dotted ones the telling segments, in lower case."""
    low = F.lower("name")
    telling = F.filter(F.split(low, r"\."), lambda p: (F.length(p) > 2) & ~p.isin(*GENERIC_TERMS) & ~p.rlike("^[0-9]+$"))
    parts = F.when(F.contains(low, F.lit(".")), telling).otherwise(F.array().cast("array<string>"))
    return names.filter(F.length("name") > 0).select(F.explode(F.array_distinct(F.concat(F.array(low), parts))).alias("term")).distinct()


def search_key(term: Column) -> Column:
    """What a term is searched as."""
    parts = F.split(term, r"\.")
    telling = F.filter(parts, lambda p: (F.length(p) > 3) & ~p.isin(*DOMAINS))
    has = lambda p: F.array_contains(parts, p)
    dotted = F.when(has("fasterxml") & has("jackson"), "jackson fasterxml").when(has("springframework") | has("spring"), "spring framework").when(has("testcontainers"), "testcontainers")
    dotted = dotted.when(F.size(telling) > 0, F.try_element_at(telling, F.lit(-1))).otherwise(term)
    return F.when(F.contains(F.lower(term), F.lit("jetbrains.annotations")), "jetbrains annotations").when(F.size(parts) > 1, dotted).otherwise(term)


def search_queries(terms: DataFrame) -> DataFrame:
    """Rows (query, terms): terms grouped by what they are searched as, and the families among dotted terms."""
    rows = terms.select(search_key(F.col("term")).alias("query"), "term").filter(F.length("query") > 2)
    java = terms.filter(F.col("term").rlike(r"^(com|org|io|net)\."))
    family = F.filter(F.array(*map(F.lit, FAMILIES)), lambda f: F.contains(F.col("term"), f))
    whole = java.select(F.explode(family).alias("query"), "term")
    for name, queries in FURTHER.items():
        whole = whole.unionByName(java.filter(F.contains("term", F.lit(name))).select(F.explode(F.array(*map(F.lit, queries))).alias("query"), "term"))
    grouped = lambda df, kind: df.groupBy("query").agg(F.sort_array(F.collect_set("term")).alias("terms")).withColumn("kind", F.lit(kind))
    return grouped(rows, "term").unionByName(grouped(whole, "family"))


# -- matches by text, for reports only --------------------------------------------------------


def text_matches(dependencies: DataFrame, cves: DataFrame) -> DataFrame:
    """Rows (cve_id, dep_id, confidence, match_type): descriptions that name a dependency's package or its last segment."""
    named = dependencies.filter(F.length("package") > 0).select("dep_id", F.explode(F.array_distinct(F.array(F.lower("package"), F.lower(F.substring_index("package", ".", -1))))).alias("needle"))
    told = cves.select(F.col("id").alias("cve_id"), F.lower("description").alias("text"))
    met = containing(told, named)
    return named.join(met, "needle").join(told, "text").select("cve_id", "dep_id").distinct().withColumn("confidence", F.lit(0.5)).withColumn("match_type", F.lit("text_versioned"))


def _telling_parts(name: Column) -> Column:
    some = lambda sign, pattern: F.when(F.contains(name, F.lit(sign)), F.filter(F.split(name, pattern), lambda p: (F.length(p) > 4) & ~p.isin(*GENERIC_PARTS))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.concat(some(".", r"\."), some("/", "/"), some("-", "-"), some("_", "_")), F.lower)


def text_confidence(name: Column, description: Column) -> Column:
    """Struct (affected, confidence) of a dependency's name and a description in lower case: named in full, or by its telling parts."""
    parts = _telling_parts(name)
    hits = F.size(F.filter(parts, lambda p: F.contains(description, p)))
    full = F.contains(description, F.lower(name))
    share = hits / F.size(parts)
    confidence = F.when(full, 0.95).when(F.size(parts) == 0, 0.0).when(share >= 0.8, 0.8).when(share >= 0.6, 0.6).otherwise(0.0)
    return F.struct((full | (hits >= 2)).alias("affected"), confidence.alias("confidence"))


# -- reading what was saved, and finding in it ------------------------------------------------


def saved_entries(spark: SparkSession, path: str) -> DataFrame:
    """Rows (cve, position) of saved answers of the vulnerability list, as ``normalised_cves`` takes them: files in order of their names, entries in order."""
    schema = (
        "vulnerabilities array<struct<cve:struct<id:string,published:string,descriptions:array<struct<lang:string,value:string>>,"
        "metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>,cvssMetricV30:array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>>,"
        "configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>>>>>>>>>"
    )
    files = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    return files.select("file", F.posexplode("vulnerabilities").alias("at", "v")).select("v.cve", F.struct("file", "at").alias("position"))


def saved_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``ADVISORY`` of saved answers of the advisory list: files that hold one advisory or an array of them."""
    return spark.read.schema(ADVISORY).option("multiLine", True).json(path)


def enriched(links: DataFrame, cves: DataFrame) -> DataFrame:
    """Links with what is known of their vulnerability; unknown ones have an empty description, score 0 and severity UNKNOWN."""
    told = cves.select(F.col("id").alias("cve_id"), "description", "cvss_score", "severity")
    rows = links.join(told, "cve_id", "left")
    return rows.fillna("", ["description"]).fillna(0.0, ["cvss_score"]).fillna("UNKNOWN", ["severity"])


def found_by_words(cves: DataFrame, words: str) -> DataFrame:
    """Vulnerabilities whose description has a word of the search, with how many of them, most first."""
    asked = F.array(*(F.lit(w) for w in dict.fromkeys(words.lower().split())))
    hits = F.size(F.array_intersect(asked, F.split(F.lower(F.coalesce("description", F.lit(""))), "[^a-z0-9]+")))
    return cves.withColumn("hits", hits).filter("hits > 0").orderBy(F.desc("hits"), "id")
