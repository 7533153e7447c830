"""Newest row per key, and rows of the newest date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], version: str, tie: str | None = None) -> DataFrame:
    """The row with the highest ``version`` per key, all columns kept.

    An aggregate, not a ``row_number`` window: each task keeps one row per key before the
    shuffle, so a key with very many versions costs no more than any other.
    """
    order = F.struct(version, tie) if tie else F.col(version)
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_newest"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_newest.{c}").alias(c) for c in df.columns])


def latest_date_only(df: DataFrame, date: str) -> DataFrame:
    """Rows of the highest date, through a scalar subquery."""
    return df.filter(F.col(date) == df.agg(F.max(date)).scalar())
