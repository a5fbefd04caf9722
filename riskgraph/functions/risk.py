"""Weights of the risk score and severity classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of the evidence by rank (3 high, 2 medium, 1 low, 0 none), and decay per call.
TIER_WEIGHTS = {3: 1.0, 2: 0.7, 1: 0.4, 0: 0.05}
HOP_DECAY = 0.15


def risk_score(cvss: Column, rank: Column, hops: Column) -> Column:
    """cvss times the tier's weight, divided by one plus the decay per hop; without evidence hops don't count."""
    weight = F.lit(TIER_WEIGHTS[0])
    for r in (1, 2, 3):
        weight = F.when(rank == r, F.lit(TIER_WEIGHTS[r])).otherwise(weight)
    nearness = F.when(rank > 0, F.lit(1.0) / (F.lit(1.0) + F.lit(HOP_DECAY) * hops)).otherwise(F.lit(1.0))
    return cvss * weight * nearness


def severity(cvss: Column) -> Column:
    """CRITICAL from 9, HIGH from 7, MEDIUM from 4, LOW above 0."""
    return F.when(cvss >= 9, "CRITICAL").when(cvss >= 7, "HIGH").when(cvss >= 4, "MEDIUM").when(cvss > 0, "LOW").otherwise("NONE")


def tier(rank: Column) -> Column:
    return F.when(rank >= 3, "HIGH").when(rank == 2, "MEDIUM").when(rank == 1, "LOW").otherwise("NONE")
