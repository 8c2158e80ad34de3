"""The registered queries of the engine's own operators, with the equal SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a data folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register f(tables) under a name."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return f

    return put


def scalar(name: str, table: str, key: str, columns: dict[str, tuple[str, str]], where: tuple[str, str] | None = None) -> None:
    """Register a projection given as (Spark expression, SQL expression) pairs."""

    def run(t: Tables) -> DataFrame:
        df = getattr(t, table)
        if where:
            df = df.where(where[0])
        return df.selectExpr(key, *[f"{s} AS {c}" for c, (s, _) in columns.items()])

    query(name, f"SELECT {key}, " + ", ".join(f"{d} AS {c}" for c, (_, d) in columns.items()) + f" FROM {table}" + (f" WHERE {where[1]}" if where else ""))(run)
