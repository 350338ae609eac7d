"""Where query modules register their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def values_sql(rows: list[tuple], cols: str) -> str:
    """SQL of a literal relation."""

    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool | int | float):
            return str(v).lower()
        return "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({cols})"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, fn: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} registered twice")
        self.queries[name] = fn
        if sql is not None:
            self.sql[name] = sql

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: registers the function under its name."""

        def take(fn: Query) -> Query:
            self.add(fn.__name__, fn, sql)
            return fn

        return take
