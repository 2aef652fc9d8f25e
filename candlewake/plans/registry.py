"""Queries with their SQL twins, collected from the topic modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name, with the SQL that must agree with it."""

        def keep(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.sql[fn.__name__] = sql
            return fn

        return keep


def rounded(df: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    """Round for comparison; engines differ in the last bits of a double."""
    return df.withColumns({n: F.round(n, digits) for n in names})
