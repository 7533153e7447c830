"""Gauges as exposition text, one line per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.operators.evals import eval_averages
from spanmill.operators.metrics import latency_histogram, span_count

# Metric names, help texts and kinds of the exported series.
EVAL_METRIC = "llm_eval_score"
LATENCY_METRIC = "llm_request_duration_seconds"
SPANS_METRIC = "llm_spans_total"
HEADERS = {
    EVAL_METRIC: ("Eval score from LLM evaluation", "gauge"),
    LATENCY_METRIC: ("Request duration in seconds", "histogram"),
    SPANS_METRIC: ("Total number of spans", "counter"),
}


def _section(rows: DataFrame, number: int, name: str, line: Column, order: Column) -> DataFrame:
    return rows.select(F.lit(number).alias("section"), F.lit(name).alias("metric"), order.alias("item"), line.alias("line"))


def metric_lines(spans: DataFrame, evals: DataFrame, as_of, **width: int) -> DataFrame:
    """Sample lines as (section, metric, item, line).

    Latency buckets carry cumulative counts, as the histogram type asks for.
    """
    width = width or {"hours": 1}
    scores = eval_averages(evals, as_of, **width)
    buckets = latency_histogram(spans, as_of, **width)
    total = span_count(spans, as_of, **width)
    return (
        _section(
            scores, 1, EVAL_METRIC,
            F.format_string('llm_eval_score{model="%s",metric="%s"} %.6f', "model", "metric_name", "avg_score"),
            F.concat_ws("|", "model", "metric_name"),
        )
        .unionByName(
            _section(
                buckets, 2, LATENCY_METRIC,
                F.format_string(
                    'llm_request_duration_seconds_bucket{model="%s",le="%s"} %d', "model", "le", "bucket_count"
                ),
                F.concat_ws("|", F.col("model"), F.when(F.col("le") == "+Inf", "~").otherwise(F.col("le"))),
            )
        )
        .unionByName(
            _section(total, 3, SPANS_METRIC, F.format_string("llm_spans_total %d", "span_count"), F.lit(""))
        )
    )


def exposition(spans: DataFrame, evals: DataFrame, as_of, **width: int) -> DataFrame:
    """The whole page in order: help and type lines before each section's samples."""
    samples = metric_lines(spans, evals, as_of, **width)
    spark = spans.sparkSession
    rows = ", ".join(
        f"({n}, '{name}', '{part}', '{text}')"
        for n, (name, (help_text, kind)) in enumerate(HEADERS.items(), 1)
        for part, text in (
            (" 0", ""),
            (" 1", f"# HELP {name} {help_text}"),
            (" 2", f"# TYPE {name} {kind}"),
        )
        if text or n > 1
    )
    headers = spark.sql(f"SELECT * FROM VALUES {rows} AS t(section, metric, item, line)")
    return headers.unionByName(samples).orderBy("section", "item")


def write_exposition(page: DataFrame, path: str) -> None:
    """One text file; a page holds a few lines per model and metric."""
    page.select("line").coalesce(1).write.mode("overwrite").text(path)
