"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from tripstrata.plans import coupon, dashboard, eda, models, monitor, segments, sources  # noqa: F401
from tripstrata.plans.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
