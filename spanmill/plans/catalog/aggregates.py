"""Aggregations over spans and evals."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import cost, drift, evals, metrics, rollups
from spanmill.operators.latest import latest_per_key
from spanmill.plans import derived
from spanmill.plans.catalog.drifting import DRIFT_TABLE_SQL, drift_table
from spanmill.plans.catalog.registry import query
from spanmill.plans.catalog.sql import (
    END, EVAL_IN_MONTH, IN_WEEK, MONTH, WEEK, on_evals, on_priced, on_spans, with_,
)

AS_OF = derived.AS_OF
ALL = {"days": 31}
IN_ALL = f"start_time >= {END} - INTERVAL 31 DAY AND start_time < {END}"


@query("spans_per_sec", on_spans(
    f"SELECT round(count(*) / 604800.0::DOUBLE, 9) AS spans_per_sec FROM spans WHERE {IN_WEEK}"), digits=9)
def spans_per_sec(spark, sf):
    return metrics.spans_per_sec(rollups.rollup_minute(derived.priced_spans(spark, sf)), AS_OF, **WEEK)


@query("total_cost", on_priced(f"SELECT round(sum(cost_usd), 9) AS total_cost FROM priced WHERE {IN_WEEK}"), digits=9)
def total_cost(spark, sf):
    return cost.total_cost(derived.priced_spans(spark, sf), AS_OF, **WEEK)


@query("p95_latency", on_spans(f"SELECT round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms FROM spans WHERE {IN_WEEK}"))
def p95_latency(spark, sf):
    return metrics.p95_latency(derived.spans(spark, sf), AS_OF, **WEEK)


@query("span_count", on_spans(
    f"SELECT count(*) AS span_count, count(DISTINCT trace_id) AS trace_count FROM spans WHERE {IN_WEEK}"))
def span_count(spark, sf):
    return metrics.trace_count(derived.spans(spark, sf), AS_OF, **WEEK)


@query("kpis", on_priced(
    "SELECT unnest(['Spans/sec', 'Cost', 'P95 Latency', 'Traces']) AS label, "
    "unnest([printf('%.1f', n / 86400.0), concat('$', printf('%.4f', c)), printf('%.0f', q), format('{:,}', n7)]) AS value, "
    "unnest(['span/s', 'USD', 'ms', 'traces']) AS unit FROM (SELECT "
    f"count(*) FILTER (start_time >= {END} - INTERVAL 1 DAY) AS n, sum(cost_usd) AS c, count(*) AS n7, "
    f"quantile_cont(duration_ms, 0.95) FILTER (start_time >= {END} - INTERVAL 1 DAY) AS q "
    f"FROM priced WHERE {IN_WEEK})"))
def kpis(spark, sf):
    return metrics.kpis(derived.priced_spans(spark, sf), AS_OF, rate={"days": 1}, total=WEEK)


@query("cost_by_model", on_priced(
    f"SELECT model, round(sum(cost_usd), 9) AS cost, count(*) FILTER (cost_usd IS NULL) AS unpriced_spans FROM priced WHERE {IN_ALL} GROUP BY model"),
    digits=9)
def cost_by_model(spark, sf):
    return cost.cost_by_model(derived.priced_spans(spark, sf), AS_OF, **ALL)


@query("cost_per_user", on_priced(
    f"SELECT user_id, round(sum(cost_usd), 9) AS cost, count(*) AS span_count FROM priced WHERE {IN_ALL} GROUP BY user_id"), digits=9)
def cost_per_user(spark, sf):
    return cost.cost_per_user(derived.priced_spans(spark, sf), AS_OF, **ALL)


@query("avg_cost_per_user", on_priced(
    f"SELECT round(avg(c), 9) AS avg_cost_per_user, count(*) AS users FROM (SELECT user_id, sum(cost_usd) AS c FROM priced WHERE {IN_ALL} GROUP BY 1)"),
    digits=9)
def avg_cost_per_user(spark, sf):
    return cost.avg_cost_per_user(derived.priced_spans(spark, sf), AS_OF, **ALL)


@query("latency_quantiles", on_spans(
    "SELECT model, round(quantile_cont(duration_ms, 0.5) / 1000, 9) AS p50, round(quantile_cont(duration_ms, 0.95) / 1000, 9) AS p95, "
    f"round(quantile_cont(duration_ms, 0.99) / 1000, 9) AS p99 FROM spans WHERE {IN_ALL} GROUP BY model"), digits=9)
def latency_quantiles(spark, sf):
    return metrics.latency_quantiles(derived.spans(spark, sf), AS_OF, **ALL)


@query("eval_avg", on_evals(
    f"SELECT evaluated_model AS model, metric_name, round(avg(score), 6) AS avg_score FROM evals WHERE {EVAL_IN_MONTH} GROUP BY 1, 2"))
def eval_avg(spark, sf):
    return evals.eval_averages(derived.current_evals(spark, sf, days=30), AS_OF, **MONTH)


@query("hour_count", on_spans(
    f"SELECT count(*) AS span_count FROM spans WHERE start_time >= {END} - INTERVAL 1 HOUR AND start_time < {END}"))
def hour_count(spark, sf):
    return metrics.span_count(derived.spans(spark, sf), AS_OF)


@query("toxicity_breakdown", on_evals(
    "SELECT metric_name AS category, round(avg(score), 6) AS score FROM evals "
    f"WHERE metric_name LIKE 'toxicity_%' AND {EVAL_IN_MONTH} GROUP BY 1"))
def toxicity_breakdown(spark, sf):
    return evals.toxicity_breakdown(derived.current_evals(spark, sf, days=30), AS_OF)


@query("model_comparison", on_evals(
    "SELECT evaluated_model AS model, round(avg(score) FILTER (metric_name = 'faithfulness'), 6) AS faithfulness, "
    "round(avg(score) FILTER (metric_name = 'toxicity'), 6) AS toxicity, "
    "round(avg(score) FILTER (metric_name = 'answer_relevancy'), 6) AS answer_relevancy, count(*) AS eval_count "
    f"FROM evals WHERE {EVAL_IN_MONTH} GROUP BY 1"))
def model_comparison(spark, sf):
    return evals.model_comparison(derived.current_evals(spark, sf, days=30), AS_OF)


@query("eval_total", on_evals(
    f"SELECT count(*) AS eval_count FROM evals WHERE evaluated_at >= {END} - INTERVAL 7 DAY AND evaluated_at < {END}"))
def eval_total(spark, sf):
    return evals.eval_total(derived.current_evals(spark, sf, days=7), AS_OF, **WEEK)


@query("psi_trend", with_(
    "SELECT strftime(score_date, '%Y-%m-%d') AS date, metric_type, round(avg(score), 6) AS avg_score, round(max(score), 6) AS max_score "
    "FROM drift_table WHERE metric_type = 'psi' GROUP BY score_date, metric_type", *DRIFT_TABLE_SQL))
def psi_trend(spark, sf):
    return drift.psi_trend(drift_table(spark, sf), AS_OF)


@query("drift_events", with_(
    "SELECT strftime(score_date, '%Y-%m-%d') AS date, round(avg(score), 6) AS psi_value, "
    "CASE WHEN avg(score) > 0.25 THEN 'critical' WHEN avg(score) > 0.2 THEN 'warning' ELSE 'normal' END AS alert_level "
    "FROM drift_table WHERE metric_type = 'psi' GROUP BY score_date HAVING avg(score) > 0.2", *DRIFT_TABLE_SQL))
def drift_events(spark, sf):
    return drift.drift_events(drift_table(spark, sf), AS_OF)


@query("latest_psi", with_(
    "SELECT round(avg(score), 6) AS score, strftime(max(score_date), '%Y-%m-%d') AS date FROM drift_table "
    "WHERE metric_type = 'psi' AND score_date = (SELECT max(score_date) FROM drift_table WHERE metric_type = 'psi')", *DRIFT_TABLE_SQL))
def latest_psi(spark, sf):
    return drift.latest_psi(drift_table(spark, sf))


@query("latest_per_key", on_evals("SELECT trace_id, span_id, metric_name, round(score, 6) AS score, evaluated_model, evaluated_at, inserted_at, doc_id FROM evals"))
def latest(spark, sf):
    return latest_per_key(derived.evals(spark, sf), ["trace_id", "metric_name"], "inserted_at", "span_id")


@query("error_rate", on_spans(
    "SELECT provider, model, count(*) AS span_count, count(*) FILTER (status_code = 'ERROR') AS error_count, "
    "round(count(*) FILTER (status_code = 'ERROR') / count(*), 12) AS error_rate FROM spans GROUP BY 1, 2"), digits=12)
def error_rate(spark, sf):
    return metrics.error_rate(derived.spans(spark, sf), ["provider", "model"])


PASSED = "CASE metric_name WHEN 'faithfulness' THEN score >= 0.7 WHEN 'toxicity' THEN score <= 0.5 WHEN 'answer_relevancy' THEN score >= 0.7 END"


@query("eval_pass_rate", on_evals(
    "SELECT metric_name, evaluated_model, count(*) AS eval_count, count(*) FILTER (p) AS passed_count, round(avg(p::INT), 12) AS pass_rate "
    f"FROM (SELECT *, {PASSED} AS p FROM evals) WHERE p IS NOT NULL GROUP BY 1, 2"), digits=12)
def eval_pass_rate(spark, sf):
    return evals.eval_pass_rate(derived.current_evals(spark, sf), ["metric_name", "evaluated_model"])


HISTOGRAM = (
    "histogram AS (SELECT model, unnest(['0.5', '2.0', '5.0', '+Inf']) AS le, "
    "unnest([count(*) FILTER (duration_ms / 1000 <= 0.5), count(*) FILTER (duration_ms / 1000 <= 2.0), "
    f"count(*) FILTER (duration_ms / 1000 <= 5.0), count(duration_ms)]) AS bucket_count FROM spans WHERE {IN_ALL} GROUP BY model)"
)


@query("latency_histogram", on_spans("SELECT model, le, bucket_count FROM histogram", HISTOGRAM))
def latency_histogram(spark, sf):
    return metrics.latency_histogram(derived.spans(spark, sf), AS_OF, **ALL)


@query("histogram_quantile", on_spans(
    "SELECT model, round(CASE WHEN n = 0 THEN NULL WHEN b1 >= 0.9 * n THEN 0.5 * (0.9 * n / b1) "
    "WHEN b2 >= 0.9 * n THEN 0.5 + 1.5 * ((0.9 * n - b1) / (b2 - b1)) "
    "WHEN b3 >= 0.9 * n THEN 2.0 + 3.0 * ((0.9 * n - b2) / (b3 - b2)) ELSE 5.0 END, 6) AS p90 "
    "FROM (SELECT model, max(bucket_count) FILTER (le = '0.5')::DOUBLE AS b1, max(bucket_count) FILTER (le = '2.0')::DOUBLE AS b2, "
    "max(bucket_count) FILTER (le = '5.0')::DOUBLE AS b3, max(bucket_count) FILTER (le = '+Inf')::DOUBLE AS n FROM histogram GROUP BY model)",
    HISTOGRAM))
def histogram_quantile(spark, sf):
    buckets = metrics.latency_histogram(derived.spans(spark, sf), AS_OF, **ALL)
    return metrics.histogram_quantile(buckets, ["model"], 0.9, "p90")


@query("daily_cost", on_priced(
    "SELECT cast(start_time AS date) AS day, round(sum(cost_usd), 9) AS cost, sum(cost_usd) > 1.2 AS over_budget FROM priced GROUP BY 1"), digits=9)
def daily_cost(spark, sf):
    return cost.daily_cost(derived.priced_spans(spark, sf), budget_usd=1.2)


@query("kpi_change", on_priced(
    "SELECT label, round(now, 6) AS current, round(before, 6) AS previous, round((now - before) / nullif(before, 0) * 100, 6) AS change_pct FROM ("
    "SELECT unnest(['Spans/sec', 'Cost', 'P95 Latency', 'Traces']) AS label, unnest([n1 / 604800.0::DOUBLE, c1, q1, n1::DOUBLE]) AS now, "
    "unnest([n0 / 604800.0::DOUBLE, c0, q0, n0::DOUBLE]) AS before FROM (SELECT count(*) FILTER (a) AS n1, count(*) FILTER (NOT a) AS n0, "
    "sum(cost_usd) FILTER (a) AS c1, sum(cost_usd) FILTER (NOT a) AS c0, quantile_cont(duration_ms, 0.95) FILTER (a) AS q1, "
    f"quantile_cont(duration_ms, 0.95) FILTER (NOT a) AS q0 FROM (SELECT *, start_time >= {END} - INTERVAL 7 DAY AS a FROM priced "
    f"WHERE start_time >= {END} - INTERVAL 14 DAY AND start_time < {END})))"))
def kpi_change(spark, sf):
    return metrics.kpi_change(derived.priced_spans(spark, sf), AS_OF, **WEEK)
