"""The analyst tools: checked arguments in, answer envelopes out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.catalog import Graph
from riskgraph.operators import history, reach
from riskgraph.plans.report import checked_coordinate, checked_hops, envelope
from riskgraph.plans.security import risk_register as ranked_risks
from riskgraph.plans.team import graph_summary as counts


def _answer(tool: str, make: Callable[[], DataFrame], limit: int = 100, **asked) -> dict:
    try:
        return envelope(tool, make(), limit=limit, **asked)
    except ValueError as e:
        return envelope(tool, error=str(e), **asked)


def cve_reachability(g: Graph, cve_id: str, max_hops: int = reach.MAX_HOPS) -> dict:
    make = lambda: reach.reachability(g, checked_hops(max_hops), only=F.col("cve_id") == cve_id).orderBy(F.desc("confidence_rank"), "min_hops", "method_signature")
    return _answer("cve_reachability", make, cve_id=cve_id, max_hops=max_hops)


def blast_radius(g: Graph, file_path: str, min_support: int = 5) -> dict:
    pairs = lambda: history.partners_of(g.changed, g.commit, g.file.filter(F.col("path") == file_path), min_support).orderBy(F.desc("support"), F.desc("confidence"), "partner")
    return _answer("blast_radius", pairs, file_path=file_path, min_support=min_support)


def hotspots(g: Graph, days: int | None = None, top_n: int = 20) -> dict:
    return _answer("hotspots", lambda: history.hotspots(g, days).orderBy(F.desc("score"), "path").limit(top_n), days=days, top_n=top_n)


def ownership(g: Graph, path: str, days: int | None = None) -> dict:
    """Of a path prefix; a dotted package stands for its folders."""
    prefix = path if "/" in path else path.replace(".", "/")
    return _answer("ownership", lambda: history.ownership(g, prefix, days).orderBy(F.desc("commits"), "email"), path=path, days=days)


def risk_register(g: Graph, min_cvss: float = 7.0, max_hops: int = reach.MAX_HOPS, limit: int = 20) -> dict:
    """By severity, in the order of triage; ``risks_by_score`` ranks by evidence."""
    make = lambda: reach.triage(g, min_cvss, checked_hops(max_hops)).orderBy(F.desc("cvss_score"), "cve_id")
    return _answer("risk_register", make, limit, min_cvss=min_cvss, max_hops=max_hops)


def risks_by_score(g: Graph, limit: int = 20) -> dict:
    return _answer("risks_by_score", lambda: ranked_risks(g).orderBy("position"), limit)


def dependency_cves(g: Graph, gav: str) -> dict:
    def make() -> DataFrame:
        group, artifact, version = checked_coordinate(gav)
        dep = g.dependency.filter((F.col("group_id") == group) & (F.col("artifact_id") == artifact) & (F.col("version") == version))
        return dep.join(g.affects, "dep_id").join(g.cve, F.col("id") == F.col("cve_id")).select("cve_id", "cvss_score", "severity", "confidence", "match_type").orderBy(F.desc("cvss_score"), "cve_id")

    return _answer("dependency_cves", make, gav=gav)


def unreachable_cves(g: Graph, min_cvss: float = 0.0, max_hops: int = reach.MAX_HOPS) -> dict:
    make = lambda: reach.triage(g, min_cvss, checked_hops(max_hops)).filter("status <> 'REACHABLE'").orderBy(F.desc("cvss_score"), "cve_id")
    return _answer("unreachable_cves", make, min_cvss=min_cvss, max_hops=max_hops)


def graph_summary(g: Graph) -> dict:
    return _answer("graph_summary", lambda: counts(g), limit=1)
