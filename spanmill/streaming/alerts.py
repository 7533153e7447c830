"""Rules over a live stream: ticks are kept per batch, rules run on the ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanmill.functions import times
from spanmill.operators import alerts, series
from spanmill.streaming.ingest import FLUSH_SECONDS
from spanmill.streaming.merging import merge_partials
from spanmill.streaming.rollups import read_partials, write_partials


def error_ticks(spans: DataFrame, step_seconds: int, keys: list[str]) -> DataFrame:
    """Errors and spans per (keys, tick)."""
    errors = (F.col("status_code") == "ERROR").cast("long")
    return series.to_ticks(spans, "start_time", keys, step_seconds, part=errors, whole=F.lit(1).cast("long"))


def alert_ticks(
    spans: DataFrame, path: str, checkpoint: str, step_seconds: int = alerts.STEP_SECONDS,
    keys: list[str] | None = None, seconds: float | None = FLUSH_SECONDS,
) -> StreamingQuery:
    """Store the tick counts of every batch."""
    moment = F.timestamp_seconds(F.col("tick"))
    return write_partials(spans, lambda batch: error_ticks(batch, step_seconds, keys or []), path, checkpoint, seconds, moment)


def _added(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Batches may share a tick: their counts add up."""
    return ticks.groupBy(*keys, "tick").agg(F.sum("part").alias("part"), F.sum("whole").alias("whole"))


def merge_stored_ticks(spark: SparkSession, path: str, keys: list[str] | None = None) -> list[str]:
    """Merge the stored batches of ``alert_ticks`` by day."""
    return merge_partials(spark, path, lambda ticks: _added(ticks, keys or []), F.timestamp_seconds(F.col("tick")))


def evaluate_ticks(
    spark: SparkSession, path: str, rules: DataFrame, as_of, step_seconds: int = alerts.STEP_SECONDS,
    width_seconds: int = 300, keys: list[str] | None = None, since=None,
) -> DataFrame:
    """The error-ratio rules over the stored ticks, from ``since`` on if given.

    A start one trailing window plus the longest hold before the oldest open alert is
    enough, which keeps each evaluation as small as the recent past.
    """
    keys = keys or []
    ticks = read_partials(spark, path, since)
    if since is not None:
        ticks = ticks.filter(F.col("tick") >= F.unix_seconds(times.moment(since)))
    ticks = _added(ticks, keys)
    sums = series.trailing(ticks, keys, step_seconds, width_seconds, ["part", "whole"])
    ratio = sums.withColumn("value", F.when(F.col("whole") > 0, F.col("part") / F.col("whole")))
    label = F.concat_ws("|", *keys) if keys else None
    return alerts.evaluate_rules(alerts.as_signal(ratio, "error_ratio", label), rules, as_of)
