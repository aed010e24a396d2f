"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(expr: str, digits: int) -> str:
    """SQL for a rounded number without negative zero."""
    return f"coalesce(nullif(round({expr}, {digits}), 0), CAST(0 AS DOUBLE))"
