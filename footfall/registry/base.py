"""Book-keeping for registered queries: the Spark callable and, where SQL can say it, the equivalent query."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, plain: Sequence[str], values: Sequence[str], digits: int = 6) -> DataFrame:
    """Select plain columns as they are and values rounded, with -0.0 shown as 0.0."""
    return df.select(*plain, *[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) for c in values])


def r(*columns: str, digits: int = 6) -> str:
    """SQL select list with the same rounding."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c.split('.')[-1]}" for c in columns)
