"""From a repository to graph tables: full and incremental ingest, links to vulnerabilities, scores.

The order is that of the data: files, code, history, dependencies, vulnerabilities, scores.
Every table is a DataFrame; ``saved`` writes them below a folder and ``opened`` reads them
as a graph that all queries take.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.catalog import Graph
from riskgraph.durable import Stage
from riskgraph.operators import advisories, community, history, incremental, matching, provenance, rank, writers
from riskgraph.sources import build_files, git_log, java_source

CODE_ORDER = (
    "directory", "file", "in_directory", "package", "type", "interface", "extends", "interface_extends", "implements", "nested", "type_annotated", "import", "imports",
    "method", "parameter", "annotated", "throws", "creates", "calls", "calls_external", "field", "field_annotated", "doc",
)


def below(path: Column, root: str) -> Column:
    """A path from the root on."""
    bare = root.split(":", 1)[-1].rstrip("/")
    bare = "/" + bare.lstrip("/") if bare.startswith("/") else bare
    return F.regexp_replace(F.substring_index(path, f"{bare}/", -1), "^/+", "")


def parsed(spark: SparkSession, root: str, subset: DataFrame | None = None) -> DataFrame:
    """Rows of the Java files below a folder, by their paths from it; ``subset(path)`` names some of them so."""
    files = java_source.java_files(spark, root).withColumn("path", below(F.col("path"), root))
    return files if subset is None else files.join(subset.select("path").distinct(), "path", "left_semi")


def dependency_tables(imports: DataFrame, declared: DataFrame) -> dict[str, DataFrame]:
    """dependency, depends_on and missing of the imports and of what build files declare.

    External imports have a package base each; a base is a dependency node with the
    coordinate it belongs to, and so is each declared one that no base has.
    """
    outer = imports.filter("kind = 'external'").select("import_path").distinct()
    bases = advisories.import_bases(outer, declared.select("group_id"))
    found = advisories.coordinates(bases, declared)
    nodes = found.select(F.col("base").alias("dep_id"), F.col("base").alias("package"), "group_id", "artifact_id", "version")
    rest = declared.select("group_id", "artifact_id", "version").distinct().join(found.select("group_id", "artifact_id").dropna(), ["group_id", "artifact_id"], "left_anti")
    rest = rest.groupBy("group_id", "artifact_id").agg(F.min("version").alias("version"))
    nodes = nodes.unionByName(rest.select(F.concat_ws(":", "group_id", "artifact_id").alias("dep_id"), F.col("group_id").alias("package"), "group_id", "artifact_id", "version"))
    return {"dependency": nodes, "depends_on": matching.import_dependencies(outer, nodes), "missing": advisories.missing_dependencies(bases, found)}


def graph_tables(spark: SparkSession, files: DataFrame, declared: DataFrame | None = None, history_of: str | None = None, cves: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables: of parsed files, declared dependencies, a clone's history and clean vulnerability rows, as far as given."""
    stage = Stage(spark, "graph")
    out = writers.code_tables(files)
    if history_of is not None:
        out |= {name: stage.keep(df) for name, df in git_log.history_tables(spark, history_of).items()}
    if declared is not None:
        out |= {name: stage.keep(df) for name, df in dependency_tables(out["imports"], declared).items()}
        if cves is not None:
            nodes, edges = advisories.linked(cves, out["dependency"])
            out["affects"] = stage.keep(edges)
            out["cve"] = stage.keep(nodes)
    return out


def ingest(spark: SparkSession, root: str, cves: DataFrame | None = None, with_history: bool = True, resolved: str | None = None) -> dict[str, DataFrame]:
    """A full ingest of a clone. ``resolved``: a build tool's listing, whose versions go before declared ones."""
    declared = build_files.declared_dependencies(spark, root)
    if resolved is not None:
        declared = matching.filled_versions(declared, build_files.resolved_dependencies(spark, resolved))
    return graph_tables(spark, parsed(spark, root), declared, root if with_history else None, cves)


def reread(files: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Parsed rows after a change: those of touched paths are the fresh ones, removed files have none.

    Tables made of these rows equal those of a full ingest, edges across files included: what
    vanished from a file takes its edges along, and what others call anew is found.
    """
    rest = files.join(touched.select("path").distinct(), "path", "left_anti")
    return rest.select(*fresh.columns).unionByName(fresh.join(touched.filter("action = 'extract'").select("path").distinct(), "path", "left_semi"))


def run(spark: SparkSession, root: str, path: str, url: str, branch: str = "main", cves: DataFrame | None = None, forced: bool = False) -> tuple[str, str, dict[str, DataFrame]]:
    """Ingests a clone's head below ``path``, in full or what changed since the last successful run: (mode, folder, tables).

    Every run is recorded; each head has a folder of its own, so a run that fails leaves the
    last graph as it was. The parsed rows are kept beside the tables for the next run.
    """
    head = git_log.git(root, "rev-parse", "HEAD").strip()
    runs, folder = f"{path}/runs", f"{path}/{head}"
    known = provenance.known(spark, runs)
    last = incremental.last_success(provenance.runs(spark, runs), url, branch).collect() if known else []
    before = last[0]["head_sha"] if last else None
    ancestor = before is not None and git_log.is_ancestor(root, before, head)
    shallow = git_log.git(root, "rev-parse", "--is-shallow-repository").strip() == "true"
    mode, _ = incremental.ingest_mode(forced, bool(last), False, False, shallow, ancestor)
    begun = provenance.record(spark, runs, url, branch, head, mode)
    declared = build_files.declared_dependencies(spark, root)
    if mode == "full":
        rows = parsed(spark, root)
    else:
        diff = spark.createDataFrame(git_log.changed_names(root, before, head), "code string, old string, new string")
        touched = incremental.changes(diff)
        rows = reread(spark.read.parquet(f"{path}/{before}/parsed"), parsed(spark, root, touched), touched)
    if before != head or mode == "full":
        rows.write.mode("overwrite").parquet(f"{folder}/parsed")
        saved(graph_tables(spark, spark.read.parquet(f"{folder}/parsed"), declared, root, cves), folder)
    provenance.record(spark, runs, url, branch, head, mode, "success", begun)
    names = [*CODE_ORDER, "commit", "developer", "parent", "file_version", "changed", "dependency", "depends_on", "missing", *(("affects", "cve") if cves is not None else ())]
    return mode, folder, {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def require_calls(edges: DataFrame) -> None:
    """Central measures need calls."""
    if edges.isEmpty():
        raise ValueError("there are no calls to analyse; ingest the code first")


def scored_methods(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """Methods with pagerank, out_degree, in_degree, total_degree, as columns of their own; scores of an earlier run go."""
    plain = methods.drop("pagerank", "out_degree", "in_degree", "total_degree")
    scores = rank.pagerank(plain, edges, "method_signature")
    return rank.degrees(plain, edges, "method_signature").join(scores, "method_signature", "left")


def central_summary(methods: DataFrame, betweenness: DataFrame | None = None) -> DataFrame:
    """Rows (measure, class_name, name, method_signature, value): the first method by each measure, ties to the least signature."""
    def first(df: DataFrame, measure: str) -> DataFrame:
        rows = df.select(F.lit(measure).alias("measure"), "class_name", "name", "method_signature", F.col(measure).cast("double").alias("value"))
        return rows.orderBy(F.desc("value"), "method_signature").limit(1)

    out = first(methods, "pagerank").unionByName(first(methods, "total_degree"))
    if betweenness is None:
        return out
    return out.unionByName(first(methods.join(betweenness.withColumnRenamed("node", "method_signature"), "method_signature"), "betweenness"))


def analysed(tables: Mapping[str, DataFrame], with_history: bool = True) -> dict[str, DataFrame]:
    """Tables with scores written back, in order: centrality, communities, change coupling."""
    require_calls(tables["calls"])
    out = dict(tables)
    out["method"] = scored_methods(tables["method"], tables["calls"])
    labels = community.louvain(tables["calls"]).select(F.col("node").alias("method_signature"), F.col("community").alias("communityId"))
    out["method"] = out["method"].drop("communityId").join(labels, "method_signature", "left")
    if with_history and "changed" in tables:
        out["co_changed"] = history.co_changes(tables["changed"], tables["commit"])
    return out


def census(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows (kind, count) of every table, and what they say of progress."""
    rows = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("count")).select(F.lit(name).alias("kind"), "count")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def with_versions(dependencies: DataFrame, versions: DataFrame) -> DataFrame:
    """Dependencies whose version is missing or unknown take that of their group and artifact, else of their group; others keep theirs."""
    exact = versions.filter("version is not null").groupBy("group_id", "artifact_id").agg(F.min("version").alias("__exact"))
    group = versions.filter("version is not null").groupBy("group_id").agg(F.min("version").alias("__group"), F.count_distinct("version").alias("__n")).filter("__n = 1").drop("__n")
    rows = dependencies.join(exact, ["group_id", "artifact_id"], "left").join(group, "group_id", "left")
    unknown = F.col("version").isNull() | (F.col("version") == "unknown")
    return rows.withColumn("version", F.when(unknown, F.coalesce("__exact", "__group", "version")).otherwise(F.col("version"))).select(*dependencies.columns)


def saved(tables: Mapping[str, DataFrame], path: str) -> None:
    """Writes every table, in place of what was there."""
    for name in sorted(tables, key=lambda n: (CODE_ORDER.index(n) if n in CODE_ORDER else len(CODE_ORDER), n)):
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def opened(spark: SparkSession, path: str, names: list[str], shapes: Graph | None = None) -> writers.TableGraph:
    return writers.TableGraph(spark, {n: spark.read.parquet(f"{path}/{n}") for n in names}, shapes)


def exported(tables: Mapping[str, DataFrame], path: str) -> None:
    """History tables as CSV with a header, a folder each: commits, developers, files and file_changes."""
    for name, table in {"commits": "commit", "developers": "developer", "files": "file", "file_changes": "changed"}.items():
        if table in tables:
            tables[table].write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def codebase_dependencies(dependencies: DataFrame, ecosystem: str = "java:maven") -> DataFrame:
    """Rows (ecosystem, names): packages and artifacts to search advisories for, without versions."""
    name = dependencies.select(F.explode(F.array("package", "artifact_id")).alias("name")).filter("name <> ''").distinct()
    return name.groupBy(F.lit(ecosystem).alias("ecosystem")).agg(F.sort_array(F.collect_set("name")).alias("names"))


def cleaned(spark: SparkSession, path: str, names: list[str] | None = None) -> list[str]:
    """Deletes saved tables, the named ones or all, and says which were there."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    there = sorted(s.getPath().getName() for s in fs.listStatus(base)) if fs.exists(base) else []
    gone = [n for n in there if names is None or n in names]
    for n in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(base, n), True)
    return gone


def explained(frames: Mapping[str, DataFrame]) -> dict[str, str]:
    """Physical plans by name; an error says so in the place of its plan."""
    out = {}
    for name, df in frames.items():
        try:
            out[name] = df._jdf.queryExecution().executedPlan().toString()
        except Exception as e:
            out[name] = f"{type(e).__name__}: {e}"
    return out
