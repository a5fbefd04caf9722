"""Dependencies against imports and vulnerabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.functions import versions as V
from riskgraph.operators.contain import containing


def import_dependencies(imports: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Rows (import_path, dep_id): an external import's first 2, 3 or 4 segments equal a dependency's group or package, or one begins with the other.

    Names meet at segment borders. So a name of two segments and more matches an import if the
    first two are equal, and one of a single segment if that is the import's first: either is a
    key. A dependency whose two names both match is found by the key of two segments only, so
    that the matches, which can be very many, need not be told apart again.
    """
    def first(c: str, n: int) -> F.Column:
        return F.array_join(F.slice(F.split(c, r"\."), 1, n), ".")

    wanted = imports.select("import_path").distinct().filter(F.size(F.split("import_path", r"\.")) >= 2)
    # by number, so that the few rows of imports are dealt to all tasks
    wanted = wanted.repartition(int(imports.sparkSession.conf.get("spark.sql.shuffle.partitions")), "import_path")
    wanted = wanted.withColumn("two", first("import_path", 2)).withColumn("one", first("import_path", 1))
    names = dependencies.select("dep_id", F.explode(F.array("group_id", "package")).alias("name")).filter("name is not null and name <> ''")
    names = names.withColumn("long", F.size(F.split("name", r"\.")) > 1)
    long = names.filter("long").select("dep_id", first("name", 2).alias("two")).distinct()
    short = names.filter("not long").select("dep_id", F.col("name").alias("one")).distinct()
    known = long.groupBy("dep_id").agg(F.collect_set("two").alias("known"))
    short = short.join(known, short["dep_id"].eqNullSafe(known["dep_id"]), "left").select(short["dep_id"], "one", F.coalesce("known", F.array().cast("array<string>")).alias("known"))
    by_two = wanted.join(long, "two").select("import_path", "dep_id")
    by_one = wanted.join(short, "one").filter(~F.array_contains("known", F.col("two"))).select("import_path", "dep_id")
    return by_two.unionByName(by_one)


def constraints(cves: DataFrame) -> DataFrame:
    """Rows (cve_id, criteria, four bounds) of nested configurations, bounds cleaned, those without any left out."""
    rows = cves.select(F.col("id").alias("cve_id"), F.explode("configurations").alias("c")).select("cve_id", F.explode("c.nodes").alias("n")).select("cve_id", F.explode("n.cpeMatch").alias("m"))
    raw = dict(zip(V.BOUNDS, ("versionStartIncluding", "versionStartExcluding", "versionEndIncluding", "versionEndExcluding")))
    rows = rows.select("cve_id", F.col("m.criteria").alias("criteria"), *(V.cleaned(F.col(f"m.{n}")).alias(b) for b, n in raw.items()))
    return rows.filter(F.coalesce(*map(F.col, V.BOUNDS)).isNotNull())


def vulnerable_dependencies(dependencies: DataFrame, cves: DataFrame) -> DataFrame:
    """Rows (cve_id, dep_id, confidence, match_type): 1.0 by known product, 0.7 by name.

    A known product may lie anywhere in a criteria line, - and _ aside, and so may an
    artifact of five signs and more. Versions are compared for distinct pairs only.
    """
    deps = dependencies.withColumn("known", F.try_element_at(F.create_map(*(F.lit(x) for p in V.KNOWN_PRODUCTS.items() for x in p)), F.concat_ws(":", "group_id", "artifact_id")))
    lines = constraints(cves)
    products = F.array(*(V.normalised(F.lit(p)) for p in sorted(set(V.KNOWN_PRODUCTS.values()))))
    inside = F.filter(products, lambda p: V.normalised(F.col("criteria")).contains(p))
    exact = deps.filter("known is not null").withColumn("product", V.normalised(F.col("known"))).join(lines.withColumn("product", F.explode(inside)), "product")
    exact = exact.withColumn("confidence", F.lit(1.0)).withColumn("match_type", F.lit("precise_gav"))
    # by name: the artifact anywhere in the criteria
    named = deps.filter(F.col("known").isNull() & (F.length("artifact_id") > 4) & ~F.lower("artifact_id").isin(*V.GENERIC_ARTIFACTS)).withColumn("artifact", F.lower("artifact_id"))
    worded = lines.select("criteria", F.lower("criteria").alias("text")).distinct()
    within = containing(worded, named.select(F.col("artifact").alias("needle"))).withColumnRenamed("needle", "artifact").join(worded, "text").select("artifact", "criteria")
    fuzzy = named.join(within, "artifact").join(lines, "criteria")
    group_hit = F.exists(F.filter(F.split(F.lower("group_id"), r"\."), lambda g: F.length(g) > 3), lambda g: F.lower("criteria").contains(g))
    fuzzy = fuzzy.filter(group_hit).withColumn("confidence", F.lit(0.7)).withColumn("match_type", F.lit("fuzzy"))
    cols = ["cve_id", "dep_id", "version", *V.BOUNDS, "confidence", "match_type"]
    pairs = exact.select(*cols).unionByName(fuzzy.select(*cols)).withColumn("pin", F.explode(V.representatives(F.col("version"))))
    pairs = pairs.withColumn("pin", V.cleaned(F.col("pin")))
    ranges = pairs.select("pin", *V.BOUNDS).distinct().filter(V.within("pin", *V.BOUNDS))
    same = pairs["pin"] == ranges["pin"]
    for b in V.BOUNDS:
        same = same & pairs[b].eqNullSafe(ranges[b])
    hits = pairs.join(ranges, same, "left_semi")
    return hits.groupBy("cve_id", "dep_id").agg(F.max(F.struct("confidence", "match_type")).alias("b")).select("cve_id", "dep_id", "b.confidence", "b.match_type")


def normalised_cves(entries: DataFrame) -> DataFrame:
    """Clean vulnerability rows of raw entries (struct ``cve``): metrics 3.1 before 3.0, scores below 4 dropped, first of an id kept by ``position``."""
    metric = F.coalesce(F.get("cve.metrics.cvssMetricV31", F.lit(0)), F.get("cve.metrics.cvssMetricV30", F.lit(0)))
    english = F.filter("cve.descriptions", lambda d: d["lang"] == "en")
    rows = entries.select(
        F.col("cve.id").alias("id"), F.coalesce(F.get(english, F.lit(0))["value"], F.lit("")).alias("description"), F.coalesce(metric["cvssData"]["baseScore"], F.lit(0.0)).alias("cvss_score"),
        F.coalesce(metric["cvssData"]["baseSeverity"], F.lit("UNKNOWN")).alias("severity"), F.col("cve.published").alias("published"), F.col("cve.configurations").alias("configurations"), "position",
    )
    rows = rows.filter((F.length("id") > 0) & (F.col("cvss_score") >= 4.0))
    first = rows.groupBy("id").agg(F.min("position").alias("position"))
    return rows.join(first, ["id", "position"], "left_semi").drop("position")


def filled_versions(dependencies: DataFrame, resolved: DataFrame) -> DataFrame:
    """Dependencies with versions from a build tool's resolution where it has one, else their own; the resolution's others are added."""
    r = resolved.select("group_id", "artifact_id", F.col("version").alias("__v"))
    return dependencies.join(r, ["group_id", "artifact_id"], "full").withColumn("version", F.coalesce("__v", "version")).drop("__v")


def one_scope(dependencies: DataFrame, order: str = "position") -> DataFrame:
    """One row per group and artifact: the strongest scope, then the first."""
    from riskgraph.functions.names import SCOPE_PRIORITY

    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in SCOPE_PRIORITY.items() for x in p)), "scope"), F.lit(0))
    best = dependencies.groupBy("group_id", "artifact_id").agg(F.min_by(F.struct(*dependencies.columns), F.struct(-weight, order)).alias("b"))
    return best.select("b.*")
