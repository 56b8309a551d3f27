"""All registered queries."""

from __future__ import annotations

from fieldcal.plans import queries_estimates, queries_scores, queries_spatial, queries_storage, queries_tables, sql_views  # noqa: F401
from fieldcal.plans.registry import ORACLES, QUERIES, Query, complete_sql


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: complete_sql(sql) for name, sql in ORACLES.items()}
