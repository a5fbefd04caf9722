"""Version bounds: cleaning, ranges, and whether a version lies within them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Vendor and product under which the vulnerability list files these artifacts.
KNOWN_PRODUCTS = {
    "org.apache.commons:commons-lang3": "apache:commons_lang",
    "org.apache.commons:commons-collections4": "apache:commons_collections",
    "org.springframework:spring-core": "vmware:spring_framework",
    "org.springframework:spring-boot": "vmware:spring_boot",
    "org.springframework.security:spring-security-core": "vmware:spring_security",
    "com.fasterxml.jackson.core:jackson-core": "fasterxml:jackson-core",
    "com.fasterxml.jackson.core:jackson-databind": "fasterxml:jackson-databind",
    "org.apache.logging.log4j:log4j-core": "apache:log4j",
    "junit:junit": "junit:junit",
    "org.junit.jupiter:junit-jupiter": "junit:junit5",
    "com.puppycrawl.tools:checkstyle": "checkstyle:checkstyle",
}
GENERIC_ARTIFACTS = ("core", "common", "utils", "base")
BOUNDS = ("start_including", "start_excluding", "end_including", "end_excluding")


def cleaned(version: Column) -> Column:
    """Without blanks, quotes, a leading v before a digit, or signs at the end; _ becomes a dot."""
    v = F.translate(F.regexp_replace(F.trim(version), "^['\"]+|['\"]+$", ""), "_", ".")
    v = F.regexp_replace(F.regexp_replace(v, r"^v(?=\d)", ""), r"[^0-9A-Za-z.+\-]+$", "")
    return F.nullif(F.rtrim(v, F.lit(".")), F.lit(""))


def representatives(version: Column) -> Column:
    """What stands for a requirement: a pin itself, of a range the given bounds of its first interval.

    A range that names no bound, or is none, stands for what its brackets hold.
    """
    v = F.trim(version)
    interval = r"[\[(]\s*([^,\])]*)\s*,\s*([^,\])]*)\s*[\])]"
    bounds = F.filter(F.array(*(F.trim(F.regexp_extract(v, interval, i)) for i in (1, 2))), lambda x: x != "")
    bare = F.array(F.regexp_replace(v, r"^[\[\]()]+|[\[\]()]+$", ""))
    return F.when(v == "", F.array().cast("array<string>")).when(~v.rlike(r"^[\[(]"), F.array(v)).when(F.size(bounds) > 0, bounds).otherwise(bare)


def _key(text: str | None):
    from packaging.version import InvalidVersion, Version

    try:
        return Version(text) if text else None
    except InvalidVersion:
        return None


def _within(version: pd.Series, si: pd.Series, se: pd.Series, ei: pd.Series, ee: pd.Series) -> pd.Series:
    memory: dict = {}

    def key(t):
        if t not in memory:
            memory[t] = _key(t)
        return memory[t]

    out = []
    for v, a, b, c, d in zip(version, si, se, ei, ee):
        x = key(v)
        lows, highs = (key(a), key(b)), (key(c), key(d))
        out.append(
            x is not None and (lows[0] is None or x >= lows[0]) and (lows[1] is None or x > lows[1]) and (highs[0] is None or x <= highs[0]) and (highs[1] is None or x < highs[1])
        )
    return pd.Series(out, dtype=bool)


def within(*columns) -> Column:
    """Whether a cleaned version (first column) satisfies all given bounds (in the order of ``BOUNDS``).

    An invalid bound is as good as none, an invalid version is in no range. Versions compare
    by PEP 440. Meant for distinct (version, bounds) rows: parsing is remembered in a batch.
    """
    return pandas_udf(_within, T.BooleanType())(*columns)


def _between(version: pd.Series, one: pd.Series, other: pd.Series) -> pd.Series:
    out = []
    for v, a, b in zip(version, one, other):
        x, (lo, hi) = _key(v), (_key(a), _key(b))
        out.append(None not in (x, lo, hi) and min(lo, hi) <= x < max(lo, hi))
    return pd.Series(out, dtype=bool)


def between(version: Column, one: Column, other: Column) -> Column:
    """Whether a version is at least the lesser and below the greater of two; false if one of them is no version."""
    return pandas_udf(_between, T.BooleanType())(version, one, other)


def advisory_range(text: Column) -> Column:
    """Struct of the four bounds of a range like ``>= 1.2, < 2.0`` or ``= 1.2``."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))

    def bound(*ops: str) -> Column:
        pattern = "^(" + "|".join(map(re.escape, ops)) + r")\s*([0-9A-Za-z+_.\-]+)$"
        hits = F.filter(parts, lambda p: p.rlike(pattern))
        return F.when(F.size(hits) > 0, F.regexp_extract(F.element_at(hits, -1), pattern, 2))

    names = dict(zip(BOUNDS, ((">=", "="), (">",), ("<=", "="), ("<",))))
    return F.struct(*(bound(*ops).alias(n) for n, ops in names.items()))


def product_of(group: Column, artifact: Column) -> Column:
    """Known vendor:product of an artifact, else the group's last segment and the artifact."""
    known = F.create_map(*(F.lit(x) for pair in KNOWN_PRODUCTS.items() for x in pair))
    last = F.lower(F.element_at(F.split(F.coalesce(group, F.lit("")), r"\."), -1))
    fallback = F.when(last != "", F.concat(last, F.lit(":"), F.lower(artifact))).otherwise(F.lower(artifact))
    return F.coalesce(F.try_element_at(known, F.concat(group, F.lit(":"), artifact)), fallback)


def normalised(text: Column) -> Column:
    """Lower case without - and _."""
    return F.translate(F.lower(text), "-_", "")


def tokens(text: Column) -> Column:
    """Distinct lower-case alphanumeric tokens of three signs and more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 3))


# Products of a vendor that are no libraries, and words that tell its libraries.
VENDOR, VENDOR_LIBRARY = "jetbrains", "annotation"
VENDOR_PRODUCTS = ("teamcity", "intellij", "idea", "youtrack", "space", "hub", "kotlin", "resharper", "rider", "webstorm", "phpstorm", "pycharm", "rubymine", "clion", "goland")
VENDOR_SIGNS = ("annotation", "library", "maven", "gradle", "jar")


def relevant(text: Column, term: Column) -> Column:
    """Whether two tokens of a term, or the only one, are among a text's tokens.

    Dotted terms of one vendor count where the text tells its library, and not where it
    tells another product of the vendor or the vendor alone.
    """
    low, t = F.lower(text), tokens(term)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    hit = (F.size(t) > 0) & (F.size(F.array_intersect(t, tokens(text))) >= F.least(F.size(t), F.lit(2)))
    of_vendor = F.contains(F.lower(term), F.lit(VENDOR)) & F.contains(term, F.lit("."))
    other = any_of(VENDOR_PRODUCTS) | (F.contains(low, F.lit(VENDOR)) & ~any_of(VENDOR_SIGNS))
    return F.when(of_vendor & F.contains(low, F.lit(VENDOR_LIBRARY)), F.lit(True)).when(of_vendor & other, F.lit(False)).otherwise(hit)
