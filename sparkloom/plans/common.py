"""Reading tables, and registering a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Catalogue:
    """Queries and their SQL, filled by a decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable:
        """Registers f(t) under its name; t(table) reads a table."""

        def register(f: Callable) -> Callable:
            key = name or f.__name__
            self.queries[key] = lambda spark, sf_dir: f(lambda n: table(spark, sf_dir, n))
            if sql:
                self.oracles[key] = sql
            return f

        return register
