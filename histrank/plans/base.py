"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Queries by name and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function under its own name."""

        def register(f: Query) -> Query:
            self.queries[name or f.__name__] = f
            if sql is not None:
                self.oracle[name or f.__name__] = sql
            return f

        return register
