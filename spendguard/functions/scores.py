"""Scores used for ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def audit_score(score: Column, amount: Column) -> Column:
    """Anomaly score weighted by materiality: `score * log(1 + max(amount, 0))`."""
    return score * F.log1p(F.greatest(amount, F.lit(0.0)))
