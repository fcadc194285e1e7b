"""All queries of the library, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import change_queries, ingest_queries, matching_queries, more_queries, reports, scalar_queries, service_queries, statement_queries, stats_queries, stream_queries, workbook_queries  # noqa: F401
from .plans.register import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
