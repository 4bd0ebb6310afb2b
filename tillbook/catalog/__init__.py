"""Registry of the queries run by the driver: name -> (Spark query, oracle SQL).

Each Spark query takes (spark, sf_dir), derives the ledger tables from the
driver tables and returns a lazy DataFrame. The oracle is DuckDB SQL over
the same driver tables (views), or absent for operators that SQL cannot
state (streaming); those get a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillbook.sources.fixture_sql import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, extra_ctes: str = "", raw_sql: bool = False):
    """Decorator: register a query and, when given, its oracle SQL body (the
    fixture CTEs are prefixed unless ``raw_sql``)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle if raw_sql else with_fixtures(oracle, extra_ctes)
        return fn
    return deco


def load_all() -> None:
    from tillbook.catalog import (  # noqa: F401
        q_sources, q_cleaning, q_filters, q_joins, q_aggregations, q_windows,
        q_setops, q_composite, q_posting, q_sequences, q_reversals, q_streaming, q_contracts,
    )


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLES)
