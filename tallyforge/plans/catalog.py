"""Registry of the engine's queries and of the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under `name`, with the SQL that yields the same rows if there is any."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of one type on one platform, with their evidence, summed exactly."""
    return QUERIES["financial_component_sum"](spark, sf_dir)
