"""Resolution by rungs: the first of several equi-joins that finds something decides.

Used for type references (exact name and package, same file, the only type of that name)
and for calls. A rung is an equi-join; uniqueness is counted over all candidates with a
partial sum, never by gathering them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.durable import Stage
from riskgraph.functions.names import PLATFORM_PREFIXES


def only_ones(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Candidates that are the only ones of their key."""
    lone = candidates.groupBy(*by).agg(F.count("*").alias("__n")).filter("__n = 1").select(*by)
    return candidates.join(lone, by, "left_semi")


def ladder(rows: DataFrame, key: str, rungs: list[tuple[DataFrame, list[str]]], found: str) -> DataFrame:
    """Rows joined with the first rung that matches their key; rows without any are dropped.

    A rung is (candidates with a column ``found``, columns to join on). All matches of the
    deciding rung stay. Rows that a rung has settled take no part in the next one.
    """
    left, out = rows, None
    for candidates, on in rungs:
        hit = left.join(candidates.select(*on, found).distinct(), on)
        out = hit.select(*rows.columns, found) if out is None else out.unionByName(hit.select(*rows.columns, found))
        left = left.join(hit.select(key).distinct(), key, "left_anti")
    return out


def type_references(references: DataFrame, types: DataFrame) -> DataFrame:
    """Rows (ref, name, package, file) with ``target``: exact name and package, then name and file, then the only type of the name."""
    named = types.select("name", "package", "file", F.struct("name", "file").alias("target"))
    lone = only_ones(types.select("name", "file").distinct(), ["name"]).select("name", F.struct("name", "file").alias("target"))
    return ladder(references, "ref", [(named, ["name", "package"]), (named, ["name", "file"]), (lone, ["name"])], "target")


def arity_fits(given: Column, wanted: Column) -> Column:
    return given.isNull() | wanted.isNull() | (given == wanted)


def call_edges(calls: DataFrame, methods: DataFrame, creates: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst, kind) of calls to methods of the code itself.

    ``calls``: id, src, kind, name, target (type name), argc, with the caller's owner and
    file, and package, that of the target, if known. ``methods``: sig, name, owner, file,
    arity, is_static and perhaps package. ``creates``: src, type, file of classes that a
    method makes objects of.

    Calls of the own class go to methods of the same file, of the target type first, then
    of the caller's. Static calls go to static methods of the target by name and package,
    then by name. Others go to the target's methods, then the caller's class, then classes
    that the caller creates, then the only method of that name in the file. Arity counts but
    for static calls. Each rung is an equi-join on the owner or file as well as the name, so
    calls never meet all namesakes. Which rung decides is told by the arities that there are of
    a rung's keys, a row of these for each call; only its methods are then joined. Calls are
    written once, and no table goes to the driver to be broadcast.
    """
    m = methods.select(F.col("sig").alias("dst"), "name", F.col("owner").alias("m_owner"), F.col("file").alias("m_file"), "arity", "is_static", *(["package"] if "package" in methods.columns else []))
    some = ["src", "kind", "name", "target", "argc", "owner", "file", *(["package"] if "package" in calls.columns else [])]
    stage = Stage(calls.sparkSession, "calls")
    calls = stage.keep(calls.select(*some).distinct().withColumn("call", F.monotonically_increasing_id()))
    own = F.col("kind").isin("same_class", "this")

    def met(on: dict[str, str], among: DataFrame, *more: str) -> DataFrame:
        """Methods with the columns that calls are joined on, by the calls' names of them."""
        return among.select("name", "arity", *(F.col(theirs).alias(mine) for mine, theirs in on.items()), *more)

    def told(rows: DataFrame, flag: str, on: dict[str, str], among: DataFrame = m, arity: bool = True) -> DataFrame:
        """Rows with whether a method of their name and further columns fits."""
        keys = met(on, among).groupBy("name", *on).agg(F.collect_set("arity").alias("arities"), F.bool_or(F.col("arity").isNull()).alias("loose"))
        fits = F.col("argc").isNull() | F.col("loose") | F.array_contains("arities", F.col("argc")) if arity else F.lit(True)
        return rows.join(keys.hint("merge"), ["name", *on], "left").withColumn(flag, F.col("loose").isNotNull() & F.coalesce(fits, F.lit(False))).drop("arities", "loose")

    def edges(rows: DataFrame, on: dict[str, str], among: DataFrame = m, arity: bool = True) -> DataFrame:
        rows = rows.hint("merge").join(met(on, among, "dst"), ["name", *on])
        return (rows.filter(arity_fits(F.col("argc"), F.col("arity"))) if arity else rows).select("src", "dst", "kind")

    def rungs(rows: DataFrame, steps: list[dict[str, str]], among: DataFrame = m, arity: bool = True) -> tuple[list[DataFrame], DataFrame]:
        """The edges of each step, of calls for which none before it finds something, and the calls that are left."""
        for k, on in enumerate(steps):
            rows = told(rows, f"at{k}", on, among, arity)
        rows = rows.withColumn("rung", F.coalesce(*(F.when(F.col(f"at{k}"), k) for k in range(len(steps)))))
        if len(steps) > 1:
            rows = stage.keep(rows.drop(*(f"at{k}" for k in range(len(steps)))))
        return [edges(rows.filter(F.col("rung") == k), on, among, arity) for k, on in enumerate(steps)], rows.filter("rung is null")

    near, _ = rungs(calls.filter(own), [{"file": "m_file", "target": "m_owner"}, {"file": "m_file", "owner": "m_owner"}])
    named = [{"target": "m_owner"}]
    if "package" in m.columns and "package" in calls.columns:
        named.insert(0, {"target": "m_owner", "package": "package"})
    static, _ = rungs(calls.filter("kind = 'static'"), named, m.filter("is_static"), arity=False)
    far, left = rungs(calls.filter(~own & (F.col("kind") != "static")), [{"target": "m_owner"}, {"owner": "m_owner", "file": "m_file"}])
    if creates is not None:
        made = creates.select("src", F.col("type").alias("c_type"), F.col("file").alias("c_file")).distinct()
        made = told(left.select("call", "src", "kind", "name", "argc").hint("merge").join(made, "src"), "at", {"c_type": "m_owner", "c_file": "m_file"}).filter("at")
        made = stage.keep(made)
        far.append(edges(made, {"c_type": "m_owner", "c_file": "m_file"}))
        left = left.hint("merge").join(made.select("call").distinct(), "call", "left_anti")
    # the only one is the least and the greatest
    ends = lambda of, low, high: (F.min(of).alias(low), F.max(of).alias(high))
    loose = F.when(F.col("arity").isNull(), F.col("dst"))
    by_file = met({"file": "m_file"}, m, "dst")
    all_ = by_file.groupBy("name", "file").agg(*ends("dst", "low", "high"), *ends(loose, "loose_low", "loose_high"))
    same = by_file.filter("arity is not null").groupBy("name", "file", F.col("arity").alias("argc")).agg(*ends("dst", "same_low", "same_high"))
    lone = left.join(all_.hint("merge"), ["name", "file"]).join(same.hint("merge"), ["name", "file", "argc"], "left")
    low = F.when(F.col("argc").isNull(), F.col("low")).otherwise(F.least("loose_low", "same_low"))
    high = F.when(F.col("argc").isNull(), F.col("high")).otherwise(F.greatest("loose_high", "same_high"))
    far.append(lone.filter(low == high).select("src", low.alias("dst"), "kind"))
    return reduce(DataFrame.unionByName, [*near, *static, *far]).distinct()


def external_frontier(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Rows (src, import_path, method_name, confidence_rank, call_count, ...) of calls into external imports.

    ``calls``: src, file, kind, name, target, package, resolution. ``imports``: file, import_path,
    is_wildcard, kind. The platform's packages and unresolved calls are no frontier. An
    explicitly imported type is 3 for static calls and constructors resolved by that import,
    else 2; a wildcard import is 1. Of a group the first call of the highest rank is shown.
    """
    platform = F.lit(False)
    for prefix in PLATFORM_PREFIXES:
        platform = platform | F.concat(F.col("package"), F.lit(".")).startswith(prefix)
    some = calls.filter((F.col("resolution") != "unresolved") & F.col("target").isNotNull() & F.col("package").isNotNull() & ~platform)
    outer = imports.filter("kind = 'external'")
    fqcn = some.withColumn("import_path", F.concat_ws(".", "package", "target"))
    explicit = fqcn.join(outer.filter("not is_wildcard").select("file", "import_path").distinct(), ["file", "import_path"])
    high = F.col("kind").isin("static", "constructor") & (F.col("resolution") == "explicit_import")
    explicit = explicit.withColumn("confidence_rank", F.when(high, 3).otherwise(2))
    rest = fqcn.join(explicit.select("src", "file", "target", "package").distinct(), ["src", "file", "target", "package"], "left_anti").drop("import_path").withColumn("import_path", F.col("package"))
    wild = rest.join(outer.filter("is_wildcard").select("file", "import_path").distinct(), ["file", "import_path"]).withColumn("confidence_rank", F.lit(1))
    rows = explicit.unionByName(wild)
    shown = F.max_by(F.struct("target", "kind", "resolution"), F.col("confidence_rank")).alias("shown")
    return rows.groupBy("src", "import_path", F.col("name").alias("method_name")).agg(F.max("confidence_rank").alias("confidence_rank"), F.count("*").alias("call_count"), shown)


def merged_frontier(old: DataFrame, new: DataFrame) -> DataFrame:
    """Frontier rows of two runs: the greater rank and count of either."""
    keys = ["src", "import_path", "method_name"]
    cols = [*keys, "confidence_rank", "call_count"]
    return old.select(*cols).unionByName(new.select(*cols)).groupBy(*keys).agg(F.max("confidence_rank").alias("confidence_rank"), F.max("call_count").alias("call_count"))
