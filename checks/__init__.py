"""Registered queries over the given tables and their SQL twins."""

from checks import aggregates, cleaning, detectors, ranking, streams  # noqa: F401
from checks.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
