"""Headline metrics of the span table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanmill.functions import labels, times
from spanmill.operators.quantiles import exact_quantiles

QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
# Upper bounds, in seconds, of the exported latency buckets.
LATENCY_BOUNDS = (0.5, 2.0, 5.0)
INFINITY = "+Inf"


def width_seconds(days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> int:
    return ((days * 24 + hours) * 60 + minutes) * 60 + seconds


def spans_per_sec(rollup: DataFrame, as_of, **width: int) -> DataFrame:
    """Rate over the last 5 minutes, from the minute rollup."""
    width = width or {"minutes": 5}
    recent = rollup.filter(times.within("minute", as_of, **width))
    return recent.agg(
        (F.coalesce(F.sum("span_count"), F.lit(0)) / width_seconds(**width)).alias("spans_per_sec")
    )


def p95_latency(spans: DataFrame, as_of, **width: int) -> DataFrame:
    recent = spans.filter(times.within("start_time", as_of, **(width or {"minutes": 5})))
    return exact_quantiles(recent, "duration_ms", {"p95_ms": 0.95}).select("p95_ms")


def span_count(spans: DataFrame, as_of, **width: int) -> DataFrame:
    """Spans of the last hour."""
    recent = spans.filter(times.within("start_time", as_of, **(width or {"hours": 1})))
    return recent.agg(F.count(F.lit(1)).alias("span_count"))


def trace_count(spans: DataFrame, as_of, **width: int) -> DataFrame:
    """Spans and distinct traces of the last hour."""
    recent = spans.filter(times.within("start_time", as_of, **(width or {"hours": 1})))
    return recent.agg(
        F.count(F.lit(1)).alias("span_count"), F.countDistinct("trace_id").alias("trace_count")
    )


def kpis(spans: DataFrame, as_of, rate: dict | None = None, total: dict | None = None) -> DataFrame:
    """Four (label, value, unit) rows: one aggregate over the wider window, plus the exact p95.

    ``rate`` is the width for rate and latency, ``total`` the one for cost and count.
    """
    rate, total = rate or {"minutes": 5}, total or {"hours": 1}
    widest = max((rate, total), key=lambda w: width_seconds(**w))
    recent = spans.filter(times.within("start_time", as_of, **widest))
    in_rate = times.within("start_time", as_of, **rate)
    in_total = times.within("start_time", as_of, **total)
    p95 = p95_latency(spans, as_of, **rate).scalar()
    one = recent.agg(
        (F.count_if(in_rate) / width_seconds(**rate)).alias("rate"),
        F.sum(F.when(in_total, F.col("cost_usd"))).alias("cost"),
        F.count_if(in_total).alias("count"),
    ).withColumn("p95", p95)
    rows = F.array(
        _kpi("Spans/sec", labels.fixed(F.col("rate"), 1), "span/s"),
        _kpi("Cost", labels.money(F.col("cost")), "USD"),
        _kpi("P95 Latency", labels.fixed(F.col("p95"), 0), "ms"),
        _kpi("Traces", labels.grouped(F.col("count")), "traces"),
    )
    return one.select(F.inline(rows))


def _kpi(label: str, value: Column, unit: str) -> Column:
    return F.struct(F.lit(label).alias("label"), value.alias("value"), F.lit(unit).alias("unit"))


def kpi_change(spans: DataFrame, as_of, **width: int) -> DataFrame:
    """Each KPI with its value in the window before and the percent change.

    Null change where the earlier window is empty.
    """
    width = width or {"hours": 1}
    end = times.moment(as_of)
    middle = end - times.interval(**width)
    start = middle - times.interval(**width)
    ts = F.col("start_time")
    both = spans.filter((ts >= start) & (ts < end)).withColumn("_now", ts >= middle)
    now = F.col("_now")
    p95 = exact_quantiles(both, "duration_ms", {"p95": 0.95}, ["_now"])
    both_p95 = p95.agg(F.struct(F.max(F.when(now, F.col("p95"))).alias("now"), F.max(F.when(~now, F.col("p95"))).alias("before")).alias("p95"))
    sums = both.agg(
        (F.count_if(now) / width_seconds(**width)).alias("rate_now"),
        (F.count_if(~now) / width_seconds(**width)).alias("rate_before"),
        F.sum(F.when(now, F.col("cost_usd"))).alias("cost_now"),
        F.sum(F.when(~now, F.col("cost_usd"))).alias("cost_before"),
        F.count_if(now).cast("double").alias("count_now"),
        F.count_if(~now).cast("double").alias("count_before"),
    ).withColumn("p95", both_p95.scalar()).select("*", F.col("p95.now").alias("p95_now"), F.col("p95.before").alias("p95_before"))

    def row(label: str, name: str) -> Column:
        current, previous = F.col(f"{name}_now"), F.col(f"{name}_before")
        change = (current - previous) / F.nullif(previous, F.lit(0.0)) * 100
        return F.struct(
            F.lit(label).alias("label"), current.alias("current"),
            previous.alias("previous"), change.alias("change_pct"),
        )

    return sums.select(
        F.inline(F.array(
            row("Spans/sec", "rate"), row("Cost", "cost"), row("P95 Latency", "p95"), row("Traces", "count"),
        ))
    )


def latency_quantiles(spans: DataFrame, as_of, **width: int) -> DataFrame:
    """p50, p95 and p99 in seconds per model over the last hour."""
    recent = spans.filter(times.within("start_time", as_of, **(width or {"hours": 1})))
    exact = exact_quantiles(recent, "duration_ms", QUANTILES, ["model"])
    return exact.select("model", *[(F.col(q) / 1000).alias(q) for q in QUANTILES])


def latency_quantiles_approx(spans: DataFrame, as_of, accuracy: int = 10_000, **width: int) -> DataFrame:
    """The same with bounded sketches: one scan, rank error at most ``1/accuracy``."""
    recent = spans.filter(times.within("start_time", as_of, **(width or {"hours": 1})))
    wanted = F.percentile_approx("duration_ms", list(QUANTILES.values()), accuracy)
    sketched = recent.groupBy("model").agg(wanted.alias("_q"))
    return sketched.select(
        "model", *[(F.get("_q", F.lit(i)) / 1000).alias(q) for i, q in enumerate(QUANTILES)]
    )


def error_rate(spans: DataFrame, keys: list[str]) -> DataFrame:
    errors = F.count_if(F.col("status_code") == "ERROR")
    return spans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("span_count"),
        errors.alias("error_count"),
        (errors / F.count(F.lit(1))).alias("error_rate"),
    )


def bound_label(bound: float) -> str:
    return f"{bound:.1f}"


def latency_histogram(spans: DataFrame, as_of, bounds: tuple[float, ...] = LATENCY_BOUNDS, **width: int) -> DataFrame:
    """Cumulative counts per model: spans that took at most ``le`` seconds."""
    recent = spans.filter(times.within("start_time", as_of, **(width or {"hours": 1})))
    return histogram_rows(recent, ["model"], bounds)


def histogram_rows(spans: DataFrame, keys: list[str], bounds: tuple[float, ...]) -> DataFrame:
    """Rows (keys, le, bucket_count) out of one aggregate with a counter per bound."""
    seconds = F.col("duration_ms") / 1000
    counted = spans.groupBy(*keys).agg(
        *[F.count_if(seconds <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count("duration_ms").alias("_all"),
    )
    buckets = [
        F.struct(F.lit(bound_label(b)).alias("le"), F.col(f"_b{i}").alias("bucket_count"))
        for i, b in enumerate(bounds)
    ]
    buckets.append(F.struct(F.lit(INFINITY).alias("le"), F.col("_all").alias("bucket_count")))
    return counted.select(*keys, F.inline(F.array(*buckets)))


def histogram_quantile(buckets: DataFrame, keys: list[str], p: float, name: str = "quantile") -> DataFrame:
    """Quantile by linear interpolation in the first bucket that reaches the rank.

    ``buckets`` holds (keys, le, bucket_count), cumulative. A rank in the open bucket
    gives the highest finite bound; a series without samples gives null.
    """
    bound = F.when(F.col("le") == INFINITY, F.lit(float("inf"))).otherwise(F.col("le").try_cast("double"))
    by_bound = W.partitionBy(*keys).orderBy("_le")
    # A series has one row per bound, so these windows see a handful of rows each.
    steps = (
        buckets.withColumn("_le", bound)
        .withColumn("_low", F.coalesce(F.lag("_le").over(by_bound), F.lit(0.0)))
        .withColumn("_under", F.coalesce(F.lag("bucket_count").over(by_bound), F.lit(0)))
        .withColumn("_rank", F.lit(float(p)) * F.max("bucket_count").over(W.partitionBy(*keys)))
    )
    reached = F.col("bucket_count") >= F.col("_rank")
    inside = F.col("bucket_count") - F.col("_under")
    value = F.when(F.col("_rank") <= 0, F.lit(None)).when(
        F.col("_le") == float("inf"), F.col("_low")
    ).otherwise(
        F.col("_low") + (F.col("_le") - F.col("_low")) * F.try_divide(F.col("_rank") - F.col("_under"), inside)
    )
    return steps.groupBy(*keys).agg(F.min_by(F.when(reached, value), F.when(reached, F.col("_le"))).alias(name))
