"""Dependencies declared in Maven and Gradle files, read with Spark."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.functions.names import coordinate
from riskgraph.operators.matching import one_scope

SCHEMA = "source_file string, group_id string, artifact_id string, version string, scope string, managed boolean, position int"
# Configuration words of the build language, by the scope they stand for.
CONFIGURATIONS = {
    "implementation": "compile", "api": "compile", "compile": "compile", "compileOnly": "compile", "runtime": "runtime", "runtimeOnly": "runtime",
    "testImplementation": "test", "testCompile": "test", "testCompileOnly": "test", "testRuntimeOnly": "test",
}


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _child(node, name: str) -> str | None:
    return next(((c.text or "").strip() for c in node if _plain(c.tag) == name), None)


def substituted(value: str | None, names: dict[str, str], most: int = 10) -> str | None:
    """A value with ${..} and $.. replaced, chained up to ``most`` steps; null while one stays unknown."""
    for _ in range(most):
        if value is None or "$" not in value:
            break
        new = re.sub(r"\$\{([^}]+)\}|\$(\w+)", lambda m: names.get(m[1] or m[2], m[0]), value)
        if new == value:
            break
        value = new
    return None if value is None or "$" in value else value


def maven(text: str) -> list[dict]:
    """Dependencies of one pom: managed ones, and direct ones that may take a managed version."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return []
    parent = next((c for c in root if _plain(c.tag) == "parent"), None)
    names = {_plain(p.tag): (p.text or "").strip() for s in root if _plain(s.tag) == "properties" for p in s}
    for key in ("version", "groupId", "artifactId"):
        own = _child(root, key) or (parent is not None and _child(parent, key)) or ""
        names.setdefault(f"project.{key}", own)
    found = []

    def take(section, managed: bool) -> None:
        for d in (d for s in section if _plain(s.tag) == "dependencies" for d in s if _plain(d.tag) == "dependency"):
            row = {k: substituted(_child(d, t), names) for k, t in (("group_id", "groupId"), ("artifact_id", "artifactId"), ("version", "version"))}
            scope = "dependencyManagement" if managed else _child(d, "scope") or "compile"
            found.append(row | {"scope": scope, "managed": managed})

    for s in root:
        if _plain(s.tag) == "dependencyManagement":
            take(s, True)
    take(root, False)
    return [r for r in found if r["group_id"] and r["artifact_id"]]


def gradle(text: str, catalog: dict[str, tuple[str, str, str]] | None = None) -> list[dict]:
    """Dependencies of one build script, in string or map form of either dialect, variables followed."""
    names = dict(re.findall(r"(\w+)\s*=\s*['\"]([^'\"]+)['\"]", text))
    words = "|".join(sorted(CONFIGURATIONS, key=len, reverse=True))
    out = []
    for m in re.finditer(rf"\b({words})\b[\s(]+(['\"])([^'\"\s]+)\2", text):
        parts = m[3].split(":")
        if len(parts) >= 3 and (version := substituted(parts[2], names)):
            out.append({"group_id": parts[0], "artifact_id": parts[1], "version": version, "scope": CONFIGURATIONS[m[1]], "managed": False})
    for m in re.finditer(rf"\b({words})\b[\s(]+((?:(?:group|name|version)\s*[:=]\s*['\"][^'\"]+['\"]\s*,?\s*)+)", text):
        named = dict(re.findall(r"(group|name|version)\s*[:=]\s*['\"]([^'\"]+)['\"]", m[2]))
        version = substituted(named.get("version"), names)
        if named.get("group") and named.get("name") and version:
            out.append({"group_id": named["group"], "artifact_id": named["name"], "version": version, "scope": CONFIGURATIONS[m[1]], "managed": False})
    for m in re.finditer(rf"\b({words})\b[\s(]+libs\.([\w.]+)", text):
        hit = (catalog or {}).get(re.sub(r"[-_]", ".", m[2]))
        if hit:
            out.append(dict(zip(("group_id", "artifact_id", "version"), hit)) | {"scope": CONFIGURATIONS[m[1]], "managed": False})
    return out


def version_catalog(text: str) -> dict[str, tuple[str, str, str]]:
    """Alias, with dots, to coordinate of a version catalog."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}
    versions, out = doc.get("versions", {}), {}
    for alias, spec in doc.get("libraries", {}).items():
        if isinstance(spec, str):
            parts = spec.split(":")
            group, name, version = (parts + [None] * 3)[:3]
        else:
            group, _, name = spec["module"].partition(":") if "module" in spec else (spec.get("group"), "", spec.get("name"))
            version = spec.get("version")
            if isinstance(version, dict):
                version = versions.get(version.get("ref"))
        if group and name and isinstance(version, str):
            out[re.sub(r"[-_]", ".", alias)] = (group, name, version)
    return out


def lockfile(text: str) -> list[dict]:
    """Locked coordinates, a line each up to the sign of equality."""
    rows = [line.partition("=")[0].split(":") for line in text.splitlines() if line.strip() and not line.startswith(("#", "empty="))]
    return [dict(zip(("group_id", "artifact_id", "version"), r)) | {"scope": "compile", "managed": False} for r in rows if len(r) == 3]


def declared_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """All dependencies below a folder, one row per group and artifact; a missing version comes from a managed row."""
    names = "{pom.xml,build.gradle,build.gradle.kts,gradle.lockfile}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.versions.toml").load(path).select("content")
    catalog: dict[str, tuple[str, str, str]] = {}
    for r in listed.toLocalIterator():  # a repository has a handful of these
        catalog |= version_catalog(bytes(r["content"]).decode("utf-8", "replace"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for at, content in zip(pdf["path"], pdf["content"]):
                text = bytes(content).decode("utf-8", "replace")
                found = maven(text) if at.endswith(".xml") else lockfile(text) if at.endswith("lockfile") else gradle(text, catalog)
                rows += [{"source_file": at, **r, "position": i} for i, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    every = files.select("path", "content").mapInPandas(parse, SCHEMA)
    managed = every.filter("managed and version is not null").groupBy("group_id", "artifact_id").agg(F.min_by("version", F.struct("source_file", "position")).alias("__v"))
    rows = every.join(managed, ["group_id", "artifact_id"], "left").withColumn("version", F.coalesce("version", "__v")).drop("__v").filter("version is not null")
    return one_scope(rows.withColumn("order", F.struct("source_file", "position")), "order").drop("order")


def resolved_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """Coordinates of a build tool's listing, kept as text files."""
    rows = spark.read.text(path).select(coordinate(F.col("value")).alias("c")).filter("c is not null")
    return rows.select("c.*").distinct()
