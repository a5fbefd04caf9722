"""Analyst queries and their SQL."""

from riskgraph.plans import architecture, centrality, ingest, security, sources, team  # noqa: F401  they register themselves
from riskgraph.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
