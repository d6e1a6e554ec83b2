"""Registry of named queries and their check statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.plans.oracle_views import with_views
from ledgerlight.session import tune
from ledgerlight.sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOME: dict[str, str] = {}
STATEMENTS: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under *name*."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        HOME[name] = fn.__module__.rsplit(".", 1)[-1]
        if oracle is not None:
            STATEMENTS[name] = oracle
            ORACLES[name] = with_views(oracle)
        return fn

    return register
