"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskgraph.catalog import Graph, fixture_graph, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a Graph under a name, with its SQL over graph tables."""

    def register(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(fixture_graph(spark, sf_dir))
        if sql:
            SQL[name] = with_tables(sql)
        return f

    return register


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in a total order."""
    return df.orderBy(*order).limit(n)
