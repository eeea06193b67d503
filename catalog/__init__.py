"""Registered queries: each pairs a Spark callable with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Both engines round with the same arithmetic. The cut sits just off the half so
# that a value exactly between two steps does not flip on the last bit of a sum.
def r6(c: Column | str, digits: int = 6) -> Column:
    c, unit = F.col(c) if isinstance(c, str) else c, 10.0**digits
    return F.floor(c * F.lit(unit) + F.lit(0.5001)).cast("double") / F.lit(unit)


def s6(expr: str, digits: int = 6) -> str:
    return f"(floor(({expr}) * 1e{digits} + 0.5001e0) / 1e{digits})"
