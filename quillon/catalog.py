"""The registered queries of the engine and their SQL.

A module of MODULES registers its queries with ``@query(name, sql)``; sql is DuckDB text over the driver's tables and
the derived tables of plans/fixtures.py, which are put in front as common table expressions where they are named.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from quillon.plans.fixtures import TABLES_SQL

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [f"quillon.{name}" for name in ("operators.dedup", "operators.filters", "operators.aggregates", "operators.risk", "operators.sla", "operators.triage", "operators.governance", "operators.joins", "operators.audit", "operators.exports", "operators.detectors", "operators.scan", "operators.taint", "operators.extents", "operators.blocks", "operators.imports", "operators.policy", "operators.context", "operators.windows", "operators.syntax", "operators.projects", "sources.readers", "sources.tools", "sources.stores", "sources.policy_versions", "functions.scalars", "streaming.queries", "streaming.timers")]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if SQL can express it, its SQL."""

    def put(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _sql[name] = with_tables(sql)
        return f

    return put


def with_tables(sql: str) -> str:
    """sql with the derived tables that it names in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in TABLES_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(body)
                needed.append(name)

    need(sql)
    if not needed:
        return sql
    tables = ", ".join(f"{n} AS ({TABLES_SQL[n]})" for n in needed)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    return f"WITH {head[1] or ''}{tables}, {sql[head.end() :]}" if head else f"WITH {tables} {sql}"


def queries() -> dict[str, Query]:
    for name in MODULES:
        import_module(name)
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    for name in MODULES:
        import_module(name)
    return dict(_sql)
