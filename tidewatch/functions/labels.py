"""Decisions, tiers and strengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the risk tiers and of the strength labels.
TIERS = [(0.80, "Critical"), (0.60, "High"), (0.40, "Medium")]
LOWEST_TIER = "Low"
STRENGTHS = [(1.5, "dominant driver"), (0.5, "strong signal"), (0.15, "moderate signal")]
LOWEST_STRENGTH = "weak signal"


def _ladder(col: Column, steps: list[tuple[float, str]], lowest: str) -> Column:
    out = F.when(col >= steps[0][0], steps[0][1])
    for bound, name in steps[1:]:
        out = out.when(col >= bound, name)
    return out.otherwise(lowest)


def churn_decision(pred: Column) -> Column:
    return F.when(pred == 1, "CHURN").otherwise("RETAIN")


def risk_tier(probability: Column) -> Column:
    """Tier of the unrounded churn probability."""
    return _ladder(probability, TIERS, LOWEST_TIER)


def strength_label(contribution: Column) -> Column:
    return _ladder(F.abs(contribution), STRENGTHS, LOWEST_STRENGTH)
