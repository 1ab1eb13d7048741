"""Registry of the named queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscribe.plans.fixtures import Inputs, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, tuple[str, str | Callable[[], str]]] = {}


def query(name: str, views: str = "", sql: str | Callable[[], str] | None = None):
    """Register a function of ``Inputs``; ``sql`` is the body after the ``WITH`` of ``views``."""

    def add(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            _SQL[name] = (views, sql)
        return fn

    return add


def oracles() -> dict[str, str]:
    return {name: with_views(views, sql() if callable(sql) else sql) for name, (views, sql) in _SQL.items()}


def r6(col: Column | str) -> Column:
    """Six decimals, and no negative zero, so that engines agree on printed sums."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6) + F.lit(0.0)


def rounded(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    chosen = set(cols)
    return df.select([r6(F.col(f"`{c}`")).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def s6(expr: str, name: str) -> str:
    """The same rounding in SQL."""
    return f"round({expr}, 6) + 0.0 AS {name}"
