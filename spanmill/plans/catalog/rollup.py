"""Rollups per minute, hour and day, and the series read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import evals, rollups
from spanmill.plans import derived
from spanmill.plans.catalog.registry import query
from spanmill.plans.catalog.sql import END, WEEK, on_evals, on_priced

AS_OF = derived.AS_OF
COLUMNS = [
    "provider", "model", "span_count", "total_input_tokens", "total_output_tokens", "total_tokens",
    "total_cost", "p95_latency_ms", "error_count",
]


def rollup_sql(bucket: str) -> str:
    # Groups this small are inside the sketch's exact range.
    return (
        f"SELECT date_trunc('{bucket}', start_time) AS {bucket}, provider, model, count(*) AS span_count, "
        "sum(input_tokens)::BIGINT AS total_input_tokens, sum(output_tokens)::BIGINT AS total_output_tokens, "
        "sum(input_tokens + output_tokens)::BIGINT AS total_tokens, round(coalesce(sum(cost_usd), 0), 9) AS total_cost, "
        "round(quantile_disc(duration_ms, 0.95), 9) AS p95_latency_ms, count(*) FILTER (status_code = 'ERROR') AS error_count "
        "FROM priced GROUP BY 1, 2, 3"
    )


MINUTES = f"minutes AS ({rollup_sql('minute')})"
EVAL_DAILY_COLUMNS = (
    "count(*) AS eval_count, round(sum(score), 6) AS total_score, round(avg(score), 6) AS avg_score, "
    "min(score) AS min_score, max(score) AS max_score"
)
DAILY = f"SELECT cast(evaluated_at AS date) AS day, evaluated_model, metric_name, {EVAL_DAILY_COLUMNS} FROM {{0}} GROUP BY 1, 2, 3"


def minutes(spark, sf):
    return rollups.rollup_minute(derived.priced_spans(spark, sf))


@query("rollup_minute", on_priced(rollup_sql("minute")), digits=9)
def rollup_minute(spark, sf):
    return minutes(spark, sf).select("minute", *COLUMNS)


@query("rollup_hour", on_priced(rollup_sql("hour")), digits=9)
def rollup_hour(spark, sf):
    return rollups.rollup_hour(minutes(spark, sf)).select("hour", *COLUMNS)


@query("eval_daily", on_evals(DAILY.format("evals")))
def eval_daily(spark, sf):
    return rollups.eval_daily(derived.current_evals(spark, sf))


@query("merge_rollup", on_priced(rollup_sql("minute")), digits=9)
def merge_rollup(spark, sf):
    """Four partial rollups, cut across minutes by the span id, merged to one."""
    spans = derived.priced_spans(spark, sf).withColumn("_part", F.pmod(F.xxhash64("span_id"), F.lit(4)))
    parts = [rollups.rollup_minute(spans.filter(F.col("_part") == i)) for i in range(4)]
    return rollups.merge_rollup("minute", *parts).select("minute", *COLUMNS)


IN_WEEK_MINUTES = f"minute >= {END} - INTERVAL 7 DAY AND minute < {END}"


@query("spans_series", on_priced(
    f"SELECT strftime(minute, '%Y-%m-%d %H:%M:%S') AS time, sum(span_count)::BIGINT AS value FROM minutes WHERE {IN_WEEK_MINUTES} GROUP BY minute", MINUTES))
def spans_series(spark, sf):
    return rollups.spans_series(minutes(spark, sf), AS_OF, **WEEK)


@query("latency_series", on_priced(
    f"SELECT DISTINCT strftime(minute, '%Y-%m-%d %H:%M:%S') AS time, round(p95_latency_ms, 6) AS value FROM minutes WHERE {IN_WEEK_MINUTES}", MINUTES))
def latency_series(spark, sf):
    return rollups.latency_series(minutes(spark, sf), AS_OF, **WEEK)


@query("latency_series_merged", on_priced(
    "SELECT strftime(date_trunc('minute', start_time), '%Y-%m-%d %H:%M:%S') AS time, round(quantile_disc(duration_ms, 0.95), 6) AS value "
    f"FROM priced WHERE date_trunc('minute', start_time) >= {END} - INTERVAL 7 DAY AND start_time < {END} GROUP BY date_trunc('minute', start_time)"))
def latency_series_merged(spark, sf):
    return rollups.latency_series_merged(minutes(spark, sf), AS_OF, **WEEK)


@query("faithfulness_trend", on_evals(
    "SELECT strftime(day, '%Y-%m-%d') AS day, evaluated_model AS model, metric_name AS metric, avg_score, eval_count FROM ("
    + DAILY.format("evals") + f") WHERE metric_name = 'faithfulness' AND day >= {END} - INTERVAL 30 DAY AND day < {END}"))
def faithfulness_trend(spark, sf):
    daily = rollups.eval_daily(derived.current_evals(spark, sf, days=30))
    return evals.faithfulness_trend(daily, AS_OF)
