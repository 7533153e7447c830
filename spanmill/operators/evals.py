"""Reports over the eval table. Readers pass it through ``current_evals`` first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.functions import times
from spanmill.operators.latest import latest_per_key

# Metric, pass threshold, and whether a high score is the good side.
PASS_RULES = [("faithfulness", 0.7, True), ("toxicity", 0.5, False), ("answer_relevancy", 0.7, True)]


def current_evals(evals: DataFrame) -> DataFrame:
    """The latest insert per (trace, metric): a re-evaluation replaces the score."""
    return latest_per_key(evals, ["trace_id", "metric_name"], "inserted_at", "span_id")


def eval_averages(evals: DataFrame, as_of, **width: int) -> DataFrame:
    """Average score per model and metric over the last hour."""
    recent = evals.filter(times.within("evaluated_at", as_of, **(width or {"hours": 1})))
    return recent.groupBy(F.col("evaluated_model").alias("model"), "metric_name").agg(
        F.avg("score").alias("avg_score")
    )


def toxicity_breakdown(evals: DataFrame, as_of, **width: int) -> DataFrame:
    """Average per ``toxicity_...`` metric; plain ``toxicity`` does not match the pattern."""
    recent = evals.filter(times.within("evaluated_at", as_of, **(width or {"days": 30})))
    return (
        recent.filter(F.col("metric_name").like("toxicity_%"))
        .groupBy(F.col("metric_name").alias("category"))
        .agg(F.avg("score").alias("score"))
        .orderBy(F.col("score").desc(), "category")
    )


def model_comparison(evals: DataFrame, as_of, **width: int) -> DataFrame:
    """Averages of three metrics side by side per model; an empty one is null, sorted last."""
    recent = evals.filter(times.within("evaluated_at", as_of, **(width or {"days": 30})))

    def average(metric: str):
        return F.avg(F.when(F.col("metric_name") == metric, F.col("score"))).alias(metric)

    return (
        recent.groupBy(F.col("evaluated_model").alias("model"))
        .agg(*[average(m) for m, _, _ in PASS_RULES], F.count(F.lit(1)).alias("eval_count"))
        .orderBy(F.col("faithfulness").desc_nulls_last(), "model")
    )


def eval_total(evals: DataFrame, as_of, **width: int) -> DataFrame:
    recent = evals.filter(times.within("evaluated_at", as_of, **(width or {"hours": 24})))
    return recent.agg(F.count(F.lit(1)).alias("eval_count"))


def passed(metric: str = "metric_name", score: str = "score"):
    """Whether a score is on the good side of its threshold; null for other metrics."""
    out = F.lit(None).cast("boolean")
    for name, threshold, high in reversed(PASS_RULES):
        good = F.col(score) >= threshold if high else F.col(score) <= threshold
        out = F.when(F.col(metric) == name, good).otherwise(out)
    return out


def eval_pass_rate(evals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of passing scores, among metrics that have a threshold."""
    judged = evals.withColumn("_passed", passed()).filter(F.col("_passed").isNotNull())
    return judged.groupBy(*(keys if keys is not None else ["metric_name"])).agg(
        F.count(F.lit(1)).alias("eval_count"),
        F.count_if("_passed").alias("passed_count"),
        F.avg(F.col("_passed").cast("double")).alias("pass_rate"),
    )


def faithfulness_trend(daily: DataFrame, as_of, **width: int) -> DataFrame:
    """Faithfulness per day and model over the last 30 days, from the day rollup."""
    recent = daily.filter(
        (F.col("metric_name") == "faithfulness")
        & times.within(F.col("day").cast("timestamp"), as_of, **(width or {"days": 30}))
    )
    return (
        recent.select("day", "evaluated_model", "metric_name", "avg_score", "eval_count").distinct()
        .orderBy("day", "evaluated_model")
        .select(
            times.format_date("day").alias("day"), F.col("evaluated_model").alias("model"),
            F.col("metric_name").alias("metric"), "avg_score", "eval_count",
        )
    )


def eval_to_span(evals: DataFrame, spans: DataFrame, how: str = "inner") -> DataFrame:
    """Eval rows with the attributes of the span they judge."""
    attributes = spans.select(
        "trace_id", "span_id", "provider", "model", "service_name", "status_code", "duration_ms", "start_time"
    )
    return evals.join(attributes, ["trace_id", "span_id"], how)


def unevaluated_spans(spans: DataFrame, evals: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Spans without any stored score, or with ``metrics`` one row (``metric_name``) for each metric a span still lacks.

    Only the keys of the evals are read; each key is there once, so a span scored very often costs no more than any other.
    """
    keys = ["trace_id", "span_id"]
    if metrics is not None:
        spans = spans.withColumn("metric_name", F.explode(F.array(*[F.lit(m) for m in metrics])))
        keys.append("metric_name")
    return spans.join(evals.select(*keys).distinct(), keys, "left_anti").select(*spans.columns)
