"""All queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollcall.plans.analogues import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True) -> Callable:
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {SQL}\n{sql}" if views else sql
        return f

    return register


def query_sql(name: str) -> str:
    """The SQL of another query, which has the same rows."""
    return ORACLES[name]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals with their vote totals, overlay resolved, filtered, ordered and paged."""
    return QUERIES["proposals_page"](spark, sf_dir)


from rollcall.plans import contracts, entities, projections, status_queries, streams  # noqa: E402, F401  they register themselves
