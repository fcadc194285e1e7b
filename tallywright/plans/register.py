"""Queries by name, each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import EVENTS_SQL, LEDGER_SQL, ledger_events, ledger_lineitem

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(spark, sf_dir)."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def on_ledger(name: str, sql: str | None = None):
    """Registers fn(ledger) over the line-item ledger; the SQL selects from ``ledger``, and may add its own CTEs."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(ledger_lineitem(spark, sf_dir))
        if sql:
            SQL[name] = f"WITH {LEDGER_SQL}" + (sql if sql.startswith(",") else f" {sql}")
        return fn

    return add


def on_events(name: str, sql: str | None = None):
    """Registers fn(ledger) over the event ledger."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(ledger_events(spark, sf_dir))
        if sql:
            SQL[name] = f"WITH {EVENTS_SQL}" + (sql if sql.startswith(",") else f" {sql}")
        return fn

    return add
