"""The queries of the engine by name, each with the SQL that gives the same rows, where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add

    def as_type(self, kind: str, columns: dict[str, str]) -> None:
        """Give columns of the SQL the type that Spark has: query -> names, apart by spaces."""
        for name, wanted in columns.items():
            casts = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c in wanted.split())
            self.sql[name] = f"SELECT * REPLACE ({casts}) FROM ({self.sql[name]})"


CORE = Registry()
