"""The registry of queries over the star-schema tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` it has no SQL twin and is tested on small fixtures."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double of the final projection and clear negative zero."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in doubles})


def r(expr: str, alias: str, digits: int = 6) -> str:
    """The same rounding as SQL text."""
    return f"round({expr}, {digits}) + 0.0 AS {alias}"


def load_all() -> None:
    from tideframe.plans import (  # noqa: F401
        queries_align, queries_archive, queries_evaluation, queries_features, queries_gaps, queries_models, queries_presentation, queries_sources, queries_tables,
    )
