"""Where queries are registered: each with a name, a callable (spark, sf_dir) and, where SQL can say the same, that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def rounded(x: Column, digits: int = 4) -> Column:
    """Rounded by arithmetic that every engine does alike, other than their round functions."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def rounded_sql(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10.0**digits} + 0.5) / {10.0**digits}"
