"""All registered queries of the graph engine and their SQL."""

from __future__ import annotations

from keelson.plans import catalogue, more_queries  # noqa: F401  more_queries registers its own
from keelson.plans.catalogue import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
