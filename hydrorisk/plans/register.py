"""Registry of runnable queries and the SQL each is checked against."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if it has one."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


# An irrational factor: no mean of short decimals, times this, ends at one half, where
# the last bit of a floating-point sum would decide the rounding.
TIE_FREE = 1e6 / math.sqrt(2)


def scaled(
    column: str | Column, digits: int = 6, name: str | None = None, factor: float | None = None
) -> Column:
    """A value as a whole number of 10^-digits, so both engines print it alike."""
    value = F.col(column) if isinstance(column, str) else column
    whole = F.rint(value * F.lit(float(factor or 10**digits))).cast("bigint")
    return whole.alias(name or column)


def scaled_sql(
    expression: str, name: str | None = None, digits: int = 6, factor: float | None = None
) -> str:
    times = float(factor or 10**digits)
    rounded = f"CAST(round_even(({expression}) * {times!r}::DOUBLE, 0) AS BIGINT)"
    return f"{rounded} AS {name or expression}"


def scaled_list(columns: list[str], digits: int = 6, factor: float | None = None) -> str:
    return ", ".join(scaled_sql(c, digits=digits, factor=factor) for c in columns)
