"""Registry of this package's queries and their SQL."""

from __future__ import annotations

from hydrorisk.plans.register import Query

LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL if it has one."""

    def add(function: Query) -> Query:
        LLM_QUERIES[function.__name__] = function
        if sql is not None:
            LLM_ORACLES[function.__name__] = sql
        return function

    return add
