"""Where query modules put their Spark function and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers the decorated function as query ``name``; ``sql`` is its DuckDB counterpart."""

        def take(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} exists")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return take

    def plain(
        self, name: str, dates: tuple[str, ...] = (), micros: tuple[str, ...] = (), lists: tuple[str, ...] = ()
    ) -> None:
        """Gives columns of a query in types that every client shows alike, in Spark and SQL: dates as ISO text, times as
        microseconds, lists joined by bars."""
        f = self.queries[name]

        def shown(spark: SparkSession, folder: str) -> DataFrame:
            df = f(spark, folder)
            new = {c: F.col(c).cast("date").cast("string") for c in dates}
            new |= {c: F.unix_micros(F.col(c).cast("timestamp")) for c in micros}
            new |= {c: F.array_join(c, "|") for c in lists}
            return df.withColumns(new)

        shown.__doc__ = f.__doc__
        self.queries[name] = shown
        if name in self.sql:
            sql = [f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in dates]
            sql += [f"epoch_us({c}) AS {c}" for c in micros] + [f"array_to_string({c}, '|') AS {c}" for c in lists]
            self.sql[name] = f"SELECT * REPLACE ({', '.join(sql)}) FROM ({self.sql[name]})"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
