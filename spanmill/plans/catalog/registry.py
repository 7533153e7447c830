"""Registration, and the common form of query results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame, digits: int) -> DataFrame:
    """Zone-free timestamps and rounded doubles, so that results compare by value."""
    columns = []
    for name, kind in df.dtypes:
        if kind == "timestamp":
            columns.append(F.col(name).cast("timestamp_ntz").alias(name))
        elif kind == "double":
            columns.append(F.round(name, digits).alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def query(key: str, sql: str | None = None, digits: int = 6):
    """Register ``(spark, sf_dir) -> DataFrame`` under ``key``."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(build(use_utc(spark), sf_dir), digits)

        run.__name__ = build.__name__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register
