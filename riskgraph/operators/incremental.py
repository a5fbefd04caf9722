"""Re-ingest of what changed since the last successful run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For each table, the columns that name the file that owns a row.
OWNED_BY = {"method": "file", "type": "file", "interface": "file", "field": "file", "doc": "file", "imports": "path"}


def changes(diff: DataFrame, suffix: str = ".java") -> DataFrame:
    """Rows (path, action) of a diff (code, old, new): extract for what is to be read again, remove for what went.

    A and C bring a new file, M and T change one, D removes one, R does both if either name counts.
    """
    code = F.upper(F.substring("code", 1, 1))
    rows = diff.withColumn("c", code).withColumn("new", F.coalesce("new", "old"))
    gone = rows.filter(F.col("c").isin("D", "R")).select(F.col("old").alias("path"), F.lit("remove").alias("action"))
    read = rows.filter(F.col("c").isin("A", "C", "M", "T", "R")).select(F.col("new").alias("path"), F.lit("extract").alias("action"))
    return gone.unionByName(read).filter(F.col("path").endswith(suffix)).distinct()


def ingest_mode(forced: bool = False, known: bool = True, branch_changed: bool = False, schema_changed: bool = False, shallow: bool = False, ancestor: bool = True) -> tuple[str, str]:
    """full or incremental, and why: the first reason for a full run decides."""
    reasons = (
        (forced, "a full run was asked for"), (not known, "no successful run is on record"), (branch_changed, "the branch changed"),
        (schema_changed, "the schema version changed"), (shallow, "the clone is shallow"), (not ancestor, "the last commit is no ancestor"),
    )
    for holds, why in reasons:
        if holds:
            return "full", why
    return "incremental", "changes since the last successful run"


def patched(tables: Mapping[str, DataFrame], fresh: Mapping[str, DataFrame], touched: DataFrame) -> dict[str, DataFrame]:
    """Tables in which the rows of touched files are those of ``fresh``; rows (path, action) say which.

    Tables without an owner column are taken from ``fresh`` where it has them. Edges that are
    resolved across files are to be derived again from the patched nodes, which makes an
    incremental run equal to a full one.
    """
    paths = touched.select("path").distinct()
    out = {}
    for name, df in tables.items():
        owner = OWNED_BY.get(name)
        if owner is None:
            out[name] = fresh.get(name, df)
            continue
        rest = df.join(paths.withColumnRenamed("path", owner), owner, "left_anti").select(*df.columns)
        out[name] = rest.unionByName(fresh[name].select(*df.columns)) if name in fresh else rest
    return out


def without_orphans(imports: DataFrame, used: DataFrame) -> DataFrame:
    """Import nodes that some file still imports."""
    return imports.join(used.select("import_path").distinct(), "import_path", "left_semi")


def new_commits(history: DataFrame, known: DataFrame) -> DataFrame:
    return history.join(known.select("sha").distinct(), "sha", "left_anti")


def last_success(runs: DataFrame, url: str, branch: str) -> DataFrame:
    """The latest successful run of a repository and branch (at most one row)."""
    rows = runs.filter((F.col("url") == url) & (F.col("branch") == branch) & (F.col("status") == "success"))
    return rows.orderBy(F.desc("finished_at"), "id").limit(1)


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    """Natural keys that are null in part or not unique; an empty result is a valid table."""
    bad = F.lit(False)
    for k in key:
        bad = bad | F.col(k).isNull()
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | bad)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same multiset of rows."""
    return a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


#: Columns of a file that say nothing once it is gone.
COUNTERS = ("total_lines", "code_lines", "method_count", "class_count", "interface_count")


def marked_deleted(files: DataFrame, touched: DataFrame, head: str) -> DataFrame:
    """Files with ``deleted_at_head``: removed ones keep their node, say since when, and lose their counters; those read again are there once more."""
    action = touched.groupBy("path").agg(F.max(F.col("action") == "extract").alias("__read"))
    rows = files.join(action, "path", "left")
    gone = F.coalesce(~F.col("__read"), F.lit(False))
    before = F.col("deleted_at_head") if "deleted_at_head" in files.columns else F.lit(None).cast("string")
    out = rows.withColumn("deleted_at_head", F.when(gone, F.lit(head)).when(F.col("__read").isNull(), before))
    for c in COUNTERS:
        if c in files.columns:
            out = out.withColumn(c, F.when(~gone, F.col(c)))
    return out.drop("__read")


def detached(nodes: DataFrame, key: str, edges: Mapping[str, tuple[DataFrame, tuple[str, ...]]], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Nodes without those whose key is in ``gone``, and edge tables (with the columns that hold the key) without their edges."""
    keys = gone.select(F.col(key).alias("__gone")).distinct()
    rest = {}
    for name, (df, columns) in edges.items():
        for c in columns:
            df = df.join(keys, F.col(c) == F.col("__gone"), "left_anti")
        rest[name] = df
    return nodes.join(keys, F.col(key) == F.col("__gone"), "left_anti"), rest


def schema_faults(tables: Mapping[str, DataFrame], keys: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Rows (table, fault, count): key columns that a table lacks, keys that are null in part, keys that repeat."""
    out = None
    for name, key in keys.items():
        df = tables[name]
        lacking = [k for k in key if k not in df.columns]
        if lacking:
            rows = df.sparkSession.createDataFrame([(name, f"no column {c}", 1) for c in lacking], "table string, fault string, count long")
        else:
            grouped = df.groupBy(*key).agg(F.count("*").alias("n"))
            null = F.lit(False)
            for k in key:
                null = null | F.col(k).isNull()
            fault = F.when(null, "null key").when(F.col("n") > 1, "repeated key")
            rows = grouped.select(fault.alias("fault")).filter("fault is not null").groupBy("fault").agg(F.count("*").alias("count")).select(F.lit(name).alias("table"), "fault", "count")
        out = rows if out is None else out.unionByName(rows)
    return out
