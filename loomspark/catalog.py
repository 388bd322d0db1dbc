"""All registered queries of the core library."""

from __future__ import annotations

from .plans import base, graph_queries, pipelines, scalar_queries, worklists  # noqa: F401  registration


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
