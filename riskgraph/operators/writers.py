"""Node and edge tables of parsed files, in the order in which they build on each other.

The input has a row per file, as the source reader gives. Names are resolved by the
ladders: by package, then file, then as the only type of a name. All tables are plain
DataFrames keyed by natural keys; an edge whose end is unknown is not written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.catalog import Graph
from riskgraph.durable import Stage
from riskgraph.functions import names
from riskgraph.operators import ladders
from riskgraph.sources.java_source import directories

#: Kinds of types that are kept as interfaces.
INTERFACES = ("interface", "annotation")


def scoped(files: DataFrame) -> DataFrame:
    """Files with what their names mean: ``explicit`` imports by simple name, ``wildcards`` of other projects."""
    plain = F.filter("imports", lambda i: ~i["is_static"] & ~i["is_wildcard"])
    simple = F.transform(plain, lambda i: F.substring_index(i["import_path"], ".", -1))
    # of a name that is imported twice the first counts
    first = F.filter(plain, lambda i, at: F.array_position(simple, F.substring_index(i["import_path"], ".", -1)) == at + 1)
    explicit = F.map_from_entries(F.transform(first, lambda i: F.struct(F.substring_index(i["import_path"], ".", -1), F.regexp_extract(i["import_path"], r"^(.*)\.[^.]*$", 1))))
    wild = F.filter("imports", lambda i: i["is_wildcard"] & ~i["is_static"] & (names.import_kind(i["import_path"], F.col("package")) == "external"))
    return files.withColumn("package", F.coalesce("package", F.lit(""))).withColumn("explicit", explicit).withColumn("wildcards", F.transform(wild, lambda i: i["import_path"]))


def _parts(files: DataFrame, part: str) -> DataFrame:
    return files.select(F.col("path").alias("file"), "package", "explicit", "wildcards", F.posexplode(part).alias("at", "x")).select("file", "package", "explicit", "wildcards", "at", "x.*")


def _has(word: str) -> Column:
    return F.array_contains("modifiers", word)


def type_tables(files: DataFrame) -> dict[str, DataFrame]:
    """type, interface, package, extends, interface_extends, implements, nested, type_annotated."""
    rows = _parts(files, "types")
    is_interface = F.col("kind").isin(*INTERFACES)
    columns = ["name", "file", "package", "kind", "line", (F.col("last_line") - F.col("line") + 1).alias("estimated_lines"), "modifiers", "enclosing"]
    types = rows.filter(~is_interface).select(*columns, F.xxhash64("name", "file").alias("cid"))
    interfaces = rows.filter(is_interface).select(*columns, F.xxhash64("name", "file").alias("iid"))

    def up(of: DataFrame, names_column: str, targets: DataFrame) -> DataFrame:
        """Rows (name, file, target) of what the types of a column name."""
        refs = of.select("name", "file", "package", "explicit", F.explode(names_column).alias("text"))
        refs = refs.select(
            F.xxhash64("name", "file", "text").alias("ref"), F.struct("name", "file").alias("by"), "file",
            names.simple_name(F.col("text")).alias("name"), names.lenient_package(F.col("text"), F.col("package"), F.col("explicit")).alias("package"),
        )
        return ladders.type_references(refs, targets).select("by.name", "by.file", "target").distinct()

    classes = rows.filter(~is_interface)
    extends = up(classes, "extends", types).select(F.col("name").alias("child"), F.col("file").alias("child_file"), F.col("target.name").alias("parent"), F.col("target.file").alias("parent_file"))
    keys = lambda name, file: F.xxhash64(name, file)
    wider = up(rows.filter(is_interface), "extends", interfaces)
    implements = up(classes, "implements", interfaces)
    nested = rows.filter("enclosing is not null").select(F.col("name").alias("child"), F.col("file").alias("child_file"), F.col("enclosing").alias("parent"), F.col("file").alias("parent_file"), F.initcap("kind").alias("kind"))
    known = rows.select(F.col("name").alias("parent"), F.col("file").alias("parent_file")).distinct()
    return {
        "type": types, "interface": interfaces, "package": rows.select("package").distinct(),
        "extends": extends.withColumn("child_id", keys("child", "child_file")).withColumn("parent_id", keys("parent", "parent_file")),
        "interface_extends": wider.select(F.col("name").alias("child"), F.col("file").alias("child_file"), F.col("target.name").alias("parent"), F.col("target.file").alias("parent_file")),
        "implements": implements.select(F.col("name").alias("class_name"), F.col("file").alias("class_file"), F.col("target.name").alias("interface"), F.col("target.file").alias("interface_file")),
        "nested": nested.join(known, ["parent", "parent_file"], "left_semi").select(*nested.columns),
        "type_annotated": rows.select("name", "file", "package", F.explode("annotations").alias("annotation")).distinct(),
    }


def method_tables(files: DataFrame, types: DataFrame, interfaces: DataFrame) -> dict[str, DataFrame]:
    """method, parameter, annotated, throws, with OF_TYPE as a parameter's type and file."""
    rows = _parts(files, "methods")
    signature = names.method_signature(F.col("package"), F.col("owner"), F.col("name"), F.transform("params", lambda p: p["type"]), F.col("returns"))
    # two methods of one signature are one node: that of the first file and line, taken whole, since
    # a place in a file's list may be another when the list is made again
    whole = F.struct(*rows.columns)
    rows = rows.groupBy(signature.alias("method_signature")).agg(F.min_by(whole, F.struct("file", "line", "at")).alias("f")).select("method_signature", "f.*")
    methods = rows.select(
        "method_signature", "name", F.col("owner").alias("class_name"), "file", "package", "line", "last_line", (F.col("last_line") - F.col("line") + 1).alias("estimated_lines"),
        _has("public").alias("is_public"), _has("static").alias("is_static"), names.in_test_path(F.col("file")).alias("is_test_method"), F.size("params").alias("arity"),
        F.col("complexity").alias("cyclomatic_complexity"), "deprecated", F.lit(None).cast("string").alias("deprecated_since"), F.col("returns").alias("return_type"), F.xxhash64("method_signature").alias("id"),
    )
    given = rows.select("method_signature", "file", "package", "explicit", F.posexplode("params").alias("idx", "p"))
    given = given.withColumn("name", names.simple_name(F.col("p.type"))).withColumn("package", names.lenient_package(F.col("p.type"), F.col("package"), F.col("explicit")))
    given = given.withColumn("ref", F.xxhash64("method_signature", "idx"))
    of_type = ladders.type_references(given.select("ref", "name", "package", "file"), types.select("name", "package", "file").unionByName(interfaces.select("name", "package", "file")))
    of_type = of_type.select("ref", F.col("target.name").alias("type"), F.col("target.file").alias("type_file"))
    parameters = given.select("ref", "method_signature", "idx", F.col("p.name").alias("name"), F.col("p.type").alias("declared")).join(of_type, "ref", "left").drop("ref")
    return {
        "method": methods, "parameter": parameters,
        "annotated": rows.select("method_signature", F.explode("annotations").alias("name")).distinct(),
        "throws": rows.select("method_signature", F.explode("throws").alias("exception")).distinct(),
    }


def resolved_calls(files: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls with caller, target, package and how it was resolved; those outside of known methods are left out."""
    calls = _parts(files, "calls").withColumnRenamed("owner", "class_name").withColumnRenamed("line", "call_line")
    callers = methods.select("method_signature", F.col("name").alias("method"), "class_name", "file", "line", "last_line")
    inside = calls.join(callers, ["file", "class_name", "method"]).filter("call_line between line and last_line")
    # of overloads side by side the one that begins last
    at = inside.groupBy("file", "at").agg(F.max(F.struct("line", "method_signature")).alias("m")).select("file", "at", F.col("m.method_signature").alias("src"))
    rows = calls.join(at, ["file", "at"])
    created, q = F.col("qualifier") == "new", F.col("qualifier")
    kind = F.when(created, "constructor").when(q == "<expression>", "instance").otherwise(names.call_kind(q))
    own = F.col("kind").isin("same_class", "this", "super")
    named = F.when(F.col("kind") == "constructor", F.col("name")).when(F.col("kind") == "static", F.substring_index("qualifier", ".", -1)).when(F.col("kind") == "instance", F.col("receiver_type"))
    rows = rows.withColumn("kind", kind).withColumn("text", named)
    strict = names.strict_package(F.coalesce("text", F.lit("")), F.col("explicit"), F.col("wildcards"))
    rows = rows.withColumn("strict", strict)
    lenient = F.when(F.col("kind") == "constructor", names.lenient_package(F.col("text"), F.col("package"), F.col("explicit")))
    return rows.select(
        F.xxhash64("file", "at").alias("id"), "src", "kind", names.simple_name(F.col("name")).alias("name"), F.when(own, F.col("class_name")).otherwise(names.simple_name(F.col("text"))).alias("target"),
        F.when(own, F.col("package")).otherwise(F.coalesce("strict.package", lenient)).alias("package"), F.when(own, "own").otherwise(F.col("strict.resolution")).alias("resolution"),
        "argc", F.col("class_name").alias("owner"), "file",
    )


def created_types(calls: DataFrame, types: DataFrame) -> DataFrame:
    """Rows (src, type, file): classes of the code that a method makes objects of."""
    refs = calls.filter("kind = 'constructor'").select(F.col("id").alias("ref"), "src", F.col("target").alias("name"), "package", "file")
    return ladders.type_references(refs, types).select("src", F.col("target.name").alias("type"), F.col("target.file").alias("file")).distinct()


def in_directories(files: DataFrame) -> DataFrame:
    """Edges (path, directory) of files that lie in a folder."""
    return files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory")).filter("directory <> ''")


def field_tables(files: DataFrame) -> dict[str, DataFrame]:
    """field and field_annotated."""
    rows = _parts(files, "fields")
    flags = [_has("public").alias("is_public"), _has("final").alias("is_final"), F.array_contains("annotations", "Autowired").alias("autowired")]
    return {
        "field": rows.select(F.col("owner").alias("owner_name"), "file", "name", "type", *flags),
        "field_annotated": rows.select(F.col("owner").alias("owner_name"), "file", "name", F.explode("annotations").alias("annotation")),
    }


def documents(files: DataFrame, methods: DataFrame, types: DataFrame) -> DataFrame:
    """Comments, those that end just above a method or type (annotations between) with its name."""
    docs = _parts(files, "docs").select("file", "kind", "text", "start_line", "end_line")
    docs = docs.withColumn("doc_id", names.document_id(F.col("file"), F.col("kind"), F.col("start_line"), F.col("end_line"), F.col("text")))
    heads = methods.select("file", "line", "method_signature", F.lit(None).cast("string").alias("class_name"))
    heads = heads.unionByName(types.select("file", "line", F.lit(None).cast("string").alias("method_signature"), F.col("name").alias("class_name")))
    # a declaration's first line may be its annotation: the nearest comment of up to three lines above
    above = heads.withColumn("end_line", F.explode(F.expr("sequence(line - 3, line - 1)"))).join(docs.select("file", "end_line", "doc_id"), ["file", "end_line"])
    best = above.groupBy("doc_id").agg(F.min(F.struct("line", "method_signature", "class_name")).alias("h")).select("doc_id", "h.method_signature", "h.class_name")
    return docs.join(best, "doc_id", "left").select("doc_id", "method_signature", "class_name", "file", "kind", "text", "start_line", "end_line")


def code_tables(files: DataFrame) -> dict[str, DataFrame]:
    """All tables of the code, each written once."""
    stage = Stage(files.sparkSession, "code")
    rows = stage.keep(scoped(files))
    out: dict[str, DataFrame] = {"directory": directories(rows.select("path"))}
    count = lambda part: F.size(part)
    types = F.filter("types", lambda t: ~t["kind"].isin(*INTERFACES))
    out["file"] = rows.select("path", "package", "total_lines", "code_lines", count("methods").alias("method_count"), F.size(types).alias("class_count"), (count("types") - F.size(types)).alias("interface_count"), "error")
    out["in_directory"] = in_directories(rows.select("path"))
    out |= type_tables(rows)
    for name in ("type", "interface"):
        out[name] = stage.keep(out[name])
    out |= method_tables(rows, out["type"], out["interface"])
    out["method"] = stage.keep(out["method"])
    imports = _parts(rows, "imports").withColumn("kind", names.import_kind(F.col("import_path"), F.col("package")))
    imports = stage.keep(imports.select(F.col("file").alias("path"), "import_path", "is_static", "is_wildcard", "kind").distinct())
    out["imports"] = imports
    out["import"] = imports.select("import_path", "is_static", "is_wildcard", "kind").distinct()
    calls = stage.keep(resolved_calls(rows, out["method"]))
    out["creates"] = stage.keep(created_types(calls, out["type"]))
    targets = out["method"].select(F.col("method_signature").alias("sig"), "name", F.col("class_name").alias("owner"), "file", "package", "arity", "is_static")
    out["calls"] = ladders.call_edges(calls.filter("kind <> 'constructor'"), targets, out["creates"])
    out["calls_external"] = ladders.external_frontier(calls, imports.withColumnRenamed("path", "file")).withColumnRenamed("src", "method_signature")
    out |= field_tables(rows)
    both = out["type"].select("name", "file", "line").unionByName(out["interface"].select("name", "file", "line"))
    out["doc"] = documents(rows, out["method"], both)
    return {name: df if hasattr(df, "_stage_path") else stage.keep(df) for name, df in out.items()}


class TableGraph(Graph):
    """A graph of tables at hand, for the same queries; a table that is not there is empty, in the shape the fixture has."""

    def __init__(self, spark, tables: dict[str, DataFrame], shapes: Graph | None = None):
        super().__init__(spark, "")
        self._made = {f"g_{name}": df for name, df in tables.items()}
        self.shapes = shapes

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            if self.shapes is None:
                raise KeyError(f"no table {name[2:]}")
            self._made[name] = self.shapes.table(name).limit(0)
        return self._made[name]
