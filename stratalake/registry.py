"""Names of all queries: each maps to a callable (spark, sf_dir) -> DataFrame and, where SQL can say it, to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: tuple[str, ...]


_ALL: dict[str, Query] = {}


def query(name: str, *, ops: str, sql: str | None = None):
    """Register a function (spark, t) where t(name) gives a table of the folder that the caller names."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        if name in _ALL:
            raise ValueError(f"two queries are named {name}")
        _ALL[name] = Query(run, sql, tuple(ops.split()))
        return f

    return put


def all_queries() -> dict[str, Query]:
    from stratalake import plans

    plans.load()
    return dict(_ALL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in all_queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in all_queries().items() if q.sql}
