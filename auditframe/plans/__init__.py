"""Registry of named queries and the independent SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditframe.sources import Inputs


class Family:
    """Named queries of one operator family with their oracle SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[Inputs], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, key: str, oracle_sql: str | None = None, types: dict[str, str] | None = None):
        """Register a query with its SQL; ``types`` casts result columns of the SQL to the types Spark gives."""
        if oracle_sql is not None and types:
            casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items())
            oracle_sql = f"SELECT * REPLACE ({casts}) FROM ({oracle_sql})"

        def register(fn: Callable[[Inputs], DataFrame]):
            self.queries[key] = fn
            if oracle_sql is not None:
                self.oracles[key] = oracle_sql
            return fn

        return register


def _families() -> list[Family]:
    import importlib
    import pkgutil

    return [
        importlib.import_module(f"{__name__}.{m.name}").FAMILY
        for m in pkgutil.iter_modules(__path__)
    ]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Inputs(spark, sf_dir))

    return {key: bind(fn) for family in _families() for key, fn in family.queries.items()}


def all_oracles() -> dict[str, str]:
    return {key: sql for family in _families() for key, sql in family.oracles.items()}
