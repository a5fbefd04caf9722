"""Property-graph tables as DataFrames.

A ``Graph`` hands out one DataFrame per node or edge table. ``fixture_graph`` maps the
star-schema test tables to graph tables; the mapping is SQL text that reads alike in Spark
and DuckDB, so the same text prefixes the queries' SQL.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed point of "now" for trailing windows; the test data ends here.
AS_OF = "2001-08-01 00:00:00"


def _file(key: str) -> str:
    return f"concat('src/m', cast(({key} % 200) % 10 as string), '/F', cast({key} % 200 as string), '.java')"


#: Table name to the SELECT that makes it of the test tables and of tables named before it.
FIXTURE_TABLES = {
    "g_developer": "SELECT c_name AS email, c_name AS name FROM customer",
    "g_commit": "SELECT cast(o_orderkey AS string) AS sha, o_orderdate AS date, o_orderpriority AS message, c_name AS author_email FROM orders JOIN customer ON c_custkey = o_custkey",
    "g_file": f"SELECT {_file('p_partkey')} AS path, count(*) AS method_count, cast(sum(p_size) AS bigint) AS total_lines, count(DISTINCT p_type) AS class_count FROM part GROUP BY 1",
    "g_changed": f"SELECT cast(l_orderkey AS string) AS sha, {_file('l_partkey')} AS path, cast(sum(l_quantity) AS bigint) AS additions, cast(sum(l_linenumber) AS bigint) AS deletions FROM lineitem GROUP BY 1, 2",
    "g_method": f"SELECT cast(p_partkey AS string) AS method_signature, p_name AS name, concat(p_type, '_', p_brand) AS class_name, {_file('p_partkey')} AS file, p_size AS estimated_lines, p_size % 2 = 0 AS is_public, p_size % 10 = 9 AS is_test_method, p_size % 5 = 0 AS is_static, p_size % 4 AS arity, 1 + p_size % 17 AS cyclomatic_complexity, p_size % 13 = 0 AS deprecated, CASE WHEN p_size % 13 = 0 THEN concat('1.', cast(p_size % 3 AS string)) END AS deprecated_since, p_partkey AS id FROM part",
    "g_calls": "SELECT DISTINCT cast(a.l_partkey AS string) AS src, cast(b.l_partkey AS string) AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 JOIN orders ON o_orderkey = a.l_orderkey WHERE o_orderstatus = 'F' AND a.l_partkey <> b.l_partkey",
    "g_annotated": "SELECT cast(p_partkey AS string) AS method_signature, CASE WHEN p_size <= 2 THEN 'GetMapping' ELSE 'Override' END AS name FROM part WHERE p_size <= 4",
    "g_dependency": "SELECT cast(s_suppkey AS string) AS dep_id, concat('org.n', cast(s_nationkey AS string)) AS group_id, s_name AS artifact_id, concat('1.', cast(s_suppkey % 10 AS string), '.0') AS version, concat('org.n', cast(s_nationkey AS string), '.', s_name) AS package FROM supplier",
    "g_cve": "SELECT concat('CVE-2024-', lpad(cast(n_nationkey AS string), 4, '0')) AS id, cast(40 + (n_nationkey * 7) % 61 AS double) / 10 AS cvss_score, CASE WHEN 40 + (n_nationkey * 7) % 61 >= 90 THEN 'CRITICAL' WHEN 40 + (n_nationkey * 7) % 61 >= 70 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, n_name AS description FROM nation",
    "g_affects": "SELECT concat('CVE-2024-', lpad(cast(s_nationkey AS string), 4, '0')) AS cve_id, cast(s_suppkey AS string) AS dep_id, CASE WHEN s_nationkey % 2 = 0 THEN cast(1.0 AS double) ELSE cast(0.7 AS double) END AS confidence, CASE WHEN s_nationkey % 2 = 0 THEN 'precise' ELSE 'fuzzy' END AS match_type FROM supplier",
    "g_depends_on": "SELECT concat('lib.', cast(s_suppkey AS string)) AS import_path, cast(s_suppkey AS string) AS dep_id FROM supplier WHERE s_nationkey % 5 <> 0",
    "g_imports": f"SELECT DISTINCT {_file('l_partkey')} AS path, concat('lib.', cast(l_suppkey AS string)) AS import_path FROM lineitem WHERE l_quantity >= 45",
    "g_calls_external": "SELECT cast(l_partkey AS string) AS method_signature, concat('lib.', cast(l_suppkey AS string)) AS import_path, l_linestatus AS method_name, max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) AS confidence_rank, count(*) AS call_count FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 45 AND s_nationkey % 5 IN (1, 2) AND (l_partkey + l_suppkey) % 10 = 0 GROUP BY 1, 2, 3",
    "g_type": "SELECT class_name AS name, file, min(id) AS cid, concat('com.app.', substr(file, 5, 2)) AS package FROM g_method GROUP BY 1, 2, 4",
    "g_extends": "SELECT c.name AS child, c.file AS child_file, p.name AS parent, p.file AS parent_file, c.cid AS child_id, p.cid AS parent_id FROM g_type c JOIN g_type p ON p.cid = floor(c.cid / 3) WHERE c.cid % 4 <> 1 AND c.cid > p.cid",
    "g_interface": f"SELECT n_name AS name, {_file('n_nationkey')} AS file, concat('com.api.r', cast(n_regionkey AS string)) AS package, n_nationkey AS iid FROM nation",
    "g_implements": "SELECT c.name AS class_name, c.file AS class_file, i.name AS interface, i.file AS interface_file FROM g_type c JOIN g_interface i ON i.iid = c.cid % 40 WHERE i.iid % 7 <> 6",
    "g_parameter": "SELECT m.method_signature, 0 AS idx, t.class_name AS type, t.file AS type_file FROM g_method m JOIN g_method t ON t.id = floor(m.id / 2) WHERE m.arity > 0",
    "g_field": "SELECT class_name AS owner_name, file, concat('f', method_signature) AS name, CASE WHEN estimated_lines % 2 = 0 THEN 'int' ELSE 'String' END AS type, estimated_lines % 3 = 0 AS is_public, estimated_lines % 5 = 0 AS is_final, estimated_lines % 4 = 0 AS autowired FROM g_method WHERE id % 3 = 0",
    "g_type_annotated": "SELECT name, file, package, 'RestController' AS annotation FROM g_type WHERE cid % 5 = 0",
    "g_throws": "SELECT method_signature, CASE WHEN estimated_lines % 7 = 0 THEN 'IOException' ELSE 'SQLException' END AS exception FROM g_method WHERE estimated_lines % 7 = 0 OR estimated_lines % 11 = 0",
    "g_doc": "SELECT method_signature, CAST(NULL AS string) AS class_name, file, name AS text, estimated_lines AS start_line, estimated_lines + 3 AS end_line FROM g_method WHERE estimated_lines % 6 = 0 UNION ALL SELECT CAST(NULL AS string), name, file, package, cast(cid % 90 AS int), cast(cid % 90 + 2 AS int) FROM g_type WHERE cid % 3 = 0",
    "g_nested": "SELECT c.name AS child, c.file AS child_file, p.name AS parent, p.file AS parent_file, CASE WHEN c.cid % 2 = 0 THEN 'Record' ELSE 'Class' END AS kind FROM g_type c JOIN g_type p ON p.cid = floor(c.cid / 9) WHERE c.cid % 9 = 0 AND c.cid > p.cid",
}

_SOURCES = re.compile(r"\b(?:FROM|JOIN)\s+(\w+)", re.I)


def needed(sql: str) -> list[str]:
    """Fixture tables that a text reads, directly or through others, in order of definition."""
    found: set[str] = set()
    todo = [t for t in FIXTURE_TABLES if re.search(rf"\b{t}\b", sql)]
    while todo:
        t = todo.pop()
        if t not in found:
            found.add(t)
            todo += [s for s in _SOURCES.findall(FIXTURE_TABLES[t]) if s in FIXTURE_TABLES]
    return [t for t in FIXTURE_TABLES if t in found]


def with_tables(sql: str) -> str:
    """A query's text with the fixture tables it reads put before it."""
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.I)
    more = re.match(r"\s*WITH\b", sql, flags=re.I)
    if not needed(sql):
        return sql
    heads = ",\n".join(f"{t} AS ({FIXTURE_TABLES[t]})" for t in needed(sql))
    word = "WITH RECURSIVE" if re.match(r"\s*WITH\s+RECURSIVE", sql, flags=re.I) else "WITH"
    return f"{word} {heads}{',' if more else ''}\n{body if more else sql}"


class Graph:
    """Node and edge tables by name, e.g. ``graph.method`` for g_method; each is defined once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        return self._made.setdefault(name, self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            text = FIXTURE_TABLES[name]
            parts = dict.fromkeys(_SOURCES.findall(text))
            frames = {p: self.table(p) if p in FIXTURE_TABLES else self.source(p) for p in parts}
            for p in parts:
                text = re.sub(rf"\b(FROM|JOIN)\s+{p}\b", rf"\1 {{{p}}}", text)
            # aliases of a table that had none are its own name, as in the text
            self._made[name] = self.spark.sql(text, **frames)
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if f"g_{name}" in FIXTURE_TABLES:
            return self.table(f"g_{name}")
        raise AttributeError(name)

    # -- chains that many queries walk ---------------------------------------------------

    @cached_property
    def authored_changes(self) -> DataFrame:
        """Developer, commit and changed file in one row."""
        return self.changed.join(self.commit, "sha").join(self.developer, self.commit["author_email"] == self.developer["email"]).select("sha", "date", "path", "email", "name", "additions", "deletions")

    @cached_property
    def exposure(self) -> DataFrame:
        """Vulnerability, dependency, import and file in one row."""
        return (
            self.cve.withColumnRenamed("id", "cve_id").join(self.affects, "cve_id").join(self.dependency, "dep_id")
            .join(self.depends_on, "dep_id").join(self.imports, "import_path")
        )

    @cached_property
    def method_type(self) -> DataFrame:
        """Methods with the package and file of the class that holds them."""
        t = self.type.select(F.col("name").alias("class_name"), "file", "package")
        return self.method.join(t, ["class_name", "file"])

    @cached_property
    def file_dependency(self) -> DataFrame:
        """Which file uses which dependency through any import."""
        return self.imports.join(self.depends_on, "import_path").select("path", "dep_id").distinct()


def fixture_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Graph tables over the test tables of a folder."""
    return Graph(spark, sf_dir)
