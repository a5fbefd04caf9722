"""Names: signatures, paths, imports, URLs, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of the platform's own packages; scopes and packaging types of build tools.
PLATFORM_PREFIXES = ("java.", "javax.")
SCOPES = ("compile", "provided", "runtime", "test", "system", "import")
TYPES = ("jar", "war", "ear", "pom", "bundle", "aar", "zip", "test-jar", "maven-plugin", "ejb")
SCOPE_PRIORITY = {"compile": 3, "runtime": 2, "test": 1, "dependencyManagement": 0}


def method_signature(package: Column, owner: Column, name: Column, types: Column, returns: Column) -> Column:
    """``package.Owner#name(T,..):R``; an unknown parameter type is ?, no return type is void."""
    head = F.concat(F.when(F.length(package) > 0, F.concat(package, F.lit("."))).otherwise(""), F.when(F.length(owner) > 0, F.concat(owner, F.lit("#"))).otherwise(""))
    params = F.array_join(F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("?"))), ",")
    return F.concat(F.coalesce(head, F.lit("")), name, F.lit("("), params, F.lit("):"), F.when(F.length(returns) > 0, returns).otherwise("void"))


def in_test_path(path: Column) -> Column:
    """Whether a path lies below src/test, test or tests, in either slash style and any case."""
    p = F.concat(F.lit("/"), F.lower(F.translate(path, "\\", "/")))
    return F.coalesce(p.rlike("/(src/test|tests?)/"), F.lit(False))


def import_kind(path: Column, own_package: Column) -> Column:
    """standard for the platform, internal for the own package and below, else external."""
    standard = F.lit(False)
    for prefix in PLATFORM_PREFIXES:
        standard = standard | path.startswith(prefix)
    own = (F.length(own_package) > 0) & ((path == own_package) | path.startswith(F.concat(own_package, F.lit("."))))
    return F.when(standard, "standard").when(F.coalesce(own, F.lit(False)), "internal").otherwise("external")


def strict_package(type_name: Column, explicit: Column, wildcards: Column) -> Column:
    """Struct (package, resolution) of a type: by its own dots, an explicit import, or the only external wildcard.

    ``explicit`` maps simple names to packages, ``wildcards`` lists external wildcard bases.
    """
    plain = F.trim(F.substring_index(type_name, "<", 1))
    dotted = plain.contains(".")
    by_import = F.try_element_at(explicit, plain)
    package = F.when(dotted, F.regexp_extract(plain, r"^(.*)\.[^.]*$", 1)).when(by_import.isNotNull(), by_import).when(F.size(wildcards) == 1, F.get(wildcards, F.lit(0)))
    how = F.when(F.coalesce(F.length(plain), F.lit(0)) == 0, "unresolved").when(dotted, "fqn").when(by_import.isNotNull(), "explicit_import").when(F.size(wildcards) == 1, "wildcard_import")
    how = F.coalesce(how, F.lit("unresolved"))
    return F.struct(F.when(how != "unresolved", package).alias("package"), how.alias("resolution"))


def repository_url(url: Column) -> Column:
    """One form for a repository: no blanks around, no trailing slashes, no .git."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"\.git$", "")


def coordinate(line: Column) -> Column:
    """Struct (group_id, artifact_id, version) of a dependency listing's line, null if it is none.

    Tree drawing goes, then a trailing scope; the version is the last field left. Types and
    scopes in the place of artifact or version, and unresolved versions, are no coordinate.
    """
    token = F.substring_index(F.trim(F.regexp_replace(line, r"^[\s|+\\`\-]*(\[INFO\])?[\s|+\\`\-]*", "")), " ", 1)
    parts = F.split(token, ":")
    last = F.lower(F.element_at(parts, -1))
    rest = F.when(last.isin(*SCOPES) & (F.size(parts) > 3), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    group, artifact, version = F.get(rest, F.lit(0)), F.get(rest, F.lit(1)), F.element_at(rest, -1)
    known = F.array(*map(F.lit, (*SCOPES, *TYPES)))
    good = (F.size(parts) >= 3) & (F.size(rest) >= 3) & (F.length(group) > 0) & (F.length(artifact) > 0) & (F.length(version) > 0)
    good = good & ~F.array_contains(known, F.lower(version)) & ~F.lower(artifact).isin(*TYPES) & ~version.contains("${")
    return F.when(good, F.struct(group.alias("group_id"), artifact.alias("artifact_id"), version.alias("version")))


def call_kind(qualifier: Column) -> Column:
    """this, super, same_class for no qualifier, static for a capitalised one, else instance."""
    q = F.coalesce(qualifier, F.lit(""))
    return F.when(q == "", "same_class").when(q == "this", "this").when(q == "super", "super").when(q.rlike("^[A-Z]"), "static").otherwise("instance")


# Words before a bracket that call nothing.
NO_CALLS = ("i", "while", "for", "switch", "catch", "synchronized", "return", "throw", "new", "assert", "super", "this")


def calls_in(code: Column) -> Column:
    """Array of (qualifier, name, kind) of what looks like a call in a piece of code; names with a capital are constructors and none."""
    pattern = r"(?:(\w+)\.)?(\w+)\s*\("
    part = lambda i: F.regexp_extract_all(code, F.lit(pattern), F.lit(i))
    pairs = F.zip_with(part(1), part(2), lambda q, n: F.struct(F.nullif(q, F.lit("")).alias("qualifier"), n.alias("name"), call_kind(q).alias("kind")))
    return F.filter(F.coalesce(pairs, F.array().cast("array<struct<qualifier:string,name:string,kind:string>>")), lambda c: ~F.lower(c["name"]).isin(*NO_CALLS) & ~c["name"].rlike(r"^\p{Lu}"))


def lenient_package(type_name: Column, own_package: Column, explicit: Column) -> Column:
    """Package of a type: by its own dots, an explicit import, else that of its file."""
    plain = F.trim(F.substring_index(type_name, "<", 1))
    return F.when(plain.contains("."), F.regexp_extract(plain, r"^(.*)\.[^.]*$", 1)).otherwise(F.coalesce(F.try_element_at(explicit, plain), own_package))


def simple_name(type_name: Column) -> Column:
    return F.substring_index(F.trim(F.substring_index(type_name, "<", 1)), ".", -1)


def document_id(file: Column, kind: Column, start: Column, end: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", file, kind, start.cast("string"), end.cast("string"), F.substring(text, 1, 64)), 256)
