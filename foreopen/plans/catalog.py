"""Every query of the library by name, with the SQL that states the same result."""

from __future__ import annotations

from foreopen.plans import decision_queries, enrich_queries, experiment_queries, market_queries, series_queries, text_queries  # noqa: F401
from foreopen.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
