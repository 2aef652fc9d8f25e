"""All registered queries and their SQL twins."""

from __future__ import annotations

from candlewake.plans import (
    bar_queries,
    event_queries,
    live_queries,
    signal_queries,
    source_queries,
    validation_queries,
)
from candlewake.plans.registry import Query

MODULES = (
    source_queries,
    bar_queries,
    event_queries,
    signal_queries,
    validation_queries,
    live_queries,
)


def queries() -> dict[str, Query]:
    return {name: fn for m in MODULES for name, fn in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.R.sql.items()}
