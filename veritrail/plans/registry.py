"""Where the queries of the driver and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with the SQL that must give the same rows, where SQL can express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def register(function: Query) -> Query:
            key = name or function.__name__
            assert key not in self.queries, key
            self.queries[key] = function
            if sql is not None:
                self.sql[key] = sql
            return function

        return register
