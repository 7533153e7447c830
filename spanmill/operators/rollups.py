"""Rollups per minute, hour and day that can be merged without loss.

Counts and sums add up, minima and maxima fold, averages are kept as sum and count, and
latencies as a KLL sketch. So hours come from minutes, and the rollup of a late batch is
merged with what is stored, without going back to the spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions import times

# Sketch size: groups of up to about this many values are kept exactly, larger ones with
# a rank error near 0.2 %. A sketch takes a few kilobytes whatever the group.
SKETCH_K = 1024
SPAN_SUMS = ["span_count", "total_input_tokens", "total_output_tokens", "total_tokens", "total_cost", "error_count"]


def span_rollup(spans: DataFrame, bucket: str, start: Column) -> DataFrame:
    """One row per (bucket, provider, model)."""
    grouped = spans.groupBy(start.alias(bucket), "provider", "model").agg(*rollup_aggregates())
    return with_p95(grouped)


def rollup_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("span_count"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"),
        F.count_if(F.col("status_code") == "ERROR").alias("error_count"),
        F.kll_sketch_agg_double("duration_ms", SKETCH_K).alias("latency_sketch"),
    ]


def with_p95(rollup: DataFrame) -> DataFrame:
    p95 = F.kll_sketch_get_quantile_double("latency_sketch", F.lit(0.95))
    return rollup.withColumn("p95_latency_ms", p95)


def rollup_minute(spans: DataFrame) -> DataFrame:
    return span_rollup(spans, "minute", times.minute_of("start_time"))


def rollup_hour(minutes: DataFrame) -> DataFrame:
    """Hours out of the minute rollup."""
    return _merge(minutes.withColumn("hour", times.hour_of("minute")), ["hour", "provider", "model"])


def _merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    merged = parts.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in SPAN_SUMS],
        F.kll_merge_agg_double("latency_sketch", SKETCH_K).alias("latency_sketch"),
    )
    return with_p95(merged)


def merge_rollup(bucket: str, *parts: DataFrame) -> DataFrame:
    """Partial rollups of several batches to one row per key."""
    columns = [bucket, "provider", "model", *SPAN_SUMS, "latency_sketch"]
    union = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    return _merge(union, [bucket, "provider", "model"])


def eval_daily(evals: DataFrame) -> DataFrame:
    """Per (day, model, metric): count, sum, average, minimum and maximum of the scores."""
    return evals.groupBy(
        times.day_of("evaluated_at").alias("day"), "evaluated_model", "metric_name"
    ).agg(
        F.count(F.lit(1)).alias("eval_count"),
        F.sum("score").alias("total_score"),
        F.avg("score").alias("avg_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )


def merge_eval_daily(*parts: DataFrame) -> DataFrame:
    """Partial day rollups to one row per key; the average is taken from sum and count."""
    union = reduce(DataFrame.unionByName, parts)
    merged = union.groupBy("day", "evaluated_model", "metric_name").agg(
        F.sum("eval_count").alias("eval_count"),
        F.sum("total_score").alias("total_score"),
        F.min("min_score").alias("min_score"),
        F.max("max_score").alias("max_score"),
    )
    return merged.withColumn("avg_score", F.col("total_score") / F.col("eval_count"))


def spans_series(minutes: DataFrame, as_of, **width: int) -> DataFrame:
    """Spans per minute over the last 24 hours."""
    recent = minutes.filter(times.within("minute", as_of, **(width or {"hours": 24})))
    return (
        recent.groupBy("minute").agg(F.sum("span_count").alias("value"))
        .orderBy("minute").select(times.format_ts("minute").alias("time"), "value")
    )


def latency_series(minutes: DataFrame, as_of, **width: int) -> DataFrame:
    """Distinct (minute, p95) of the last 24 hours: one row per minute and differing model."""
    recent = minutes.filter(times.within("minute", as_of, **(width or {"hours": 24})))
    return (
        recent.select("minute", "p95_latency_ms").distinct()
        .orderBy("minute", "p95_latency_ms")
        .select(times.format_ts("minute").alias("time"), F.col("p95_latency_ms").alias("value"))
    )


def latency_series_merged(minutes: DataFrame, as_of, **width: int) -> DataFrame:
    """One p95 per minute, over all its models, from their merged sketches."""
    recent = minutes.filter(times.within("minute", as_of, **(width or {"hours": 24})))
    merged = recent.groupBy("minute").agg(
        F.kll_merge_agg_double("latency_sketch", SKETCH_K).alias("latency_sketch")
    )
    return (
        with_p95(merged).orderBy("minute")
        .select(times.format_ts("minute").alias("time"), F.col("p95_latency_ms").alias("value"))
    )
