"""Joins and trace trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import evals, incidents, trees
from spanmill.operators.latest import latest_date_only
from spanmill.plans import derived
from spanmill.plans.catalog.drifting import DRIFT_TABLE_SQL, drift_table
from spanmill.plans.catalog.registry import query
from spanmill.plans.catalog.sql import EVALS, SPANS, on_priced, on_spans, with_


@query("span_cost", on_priced("SELECT span_id, provider, model, round(cost_usd, 9) AS cost_usd FROM priced"), digits=9)
def span_cost(spark, sf):
    return derived.priced_spans(spark, sf).select("span_id", "provider", "model", "cost_usd")


TREE = (
    "tree(trace_id, span_id, depth) AS (SELECT trace_id, span_id, 0 FROM spans s WHERE NOT EXISTS "
    "(SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id) "
    "UNION ALL SELECT c.trace_id, c.span_id, t.depth + 1 FROM tree t JOIN spans c "
    "ON c.trace_id = t.trace_id AND c.parent_span_id = t.span_id)"
)


@query("span_depth", with_("SELECT trace_id, span_id, depth FROM tree", SPANS, TREE, recursive=True))
def span_depth(spark, sf):
    return trees.span_depth(derived.spans(spark, sf))


@query("waterfall", with_(
    "SELECT s.trace_id, s.span_id, s.parent_span_id, s.span_name, s.provider, s.model, s.status_code, t.depth, s.start_time, "
    "s.duration_ms, round(greatest(s.duration_ms / greatest(max(s.duration_ms) OVER (PARTITION BY s.trace_id), 1) * 100, 2), 6) "
    "AS width_pct, s.input_tokens, s.output_tokens FROM spans s JOIN tree t USING (trace_id, span_id)",
    SPANS, TREE, recursive=True))
def waterfall(spark, sf):
    return trees.waterfall(derived.spans(spark, sf))


@query("eval_to_span", with_(
    "SELECT e.trace_id, e.span_id, metric_name, round(score, 6) AS score, provider, model, service_name, status_code, duration_ms, start_time "
    "FROM evals e JOIN spans s USING (trace_id, span_id)", SPANS, EVALS))
def eval_to_span(spark, sf):
    current = derived.current_evals(spark, sf)
    return evals.eval_to_span(current, derived.spans(spark, sf)).select(
        "trace_id", "span_id", "metric_name", "score", "provider", "model", "service_name", "status_code", "duration_ms", "start_time")


def incident_tables(spark, sf):
    """Sign-ups stand for changes, errors for detections, slow errors for alerts."""
    spans = derived.spans(spark, sf)
    errors = spans.filter("status_code = 'ERROR'")
    started = spans.filter("span_name = 'signup'").select(
        F.col("span_id").alias("incident_id"), F.col("service_name").alias("scope"), F.col("start_time").alias("injected_at"))
    detected = errors.select(F.col("service_name").alias("scope"), F.col("start_time").alias("detected_at"))
    fired = errors.filter("duration_ms > 1000").select(F.col("service_name").alias("scope"), F.col("start_time").alias("fired_at"))
    return started, detected, fired


FOUND = (
    "found AS (SELECT span_id AS incident_id, service_name AS scope, start_time AS injected_at, "
    "(SELECT min(d.start_time) FROM spans d WHERE d.service_name = s.service_name AND d.status_code = 'ERROR' "
    "AND d.start_time >= s.start_time) AS first_detected_at, "
    "(SELECT min(d.start_time) FROM spans d WHERE d.service_name = s.service_name AND d.status_code = 'ERROR' "
    "AND d.duration_ms > 1000 AND d.start_time >= s.start_time) AS first_alert_at "
    "FROM spans s WHERE span_name = 'signup')"
)
DETECT = "round((epoch_us(first_detected_at) - epoch_us(injected_at)) / 1000000.0::DOUBLE, 6)"
ALERT = "round((epoch_us(first_alert_at) - epoch_us(injected_at)) / 1000000.0::DOUBLE, 6)"


@query("detection_latency", on_spans(
    f"SELECT incident_id, scope, injected_at, first_detected_at, {DETECT} AS detect_seconds FROM found", FOUND))
def detection_latency(spark, sf):
    started, detected, _ = incident_tables(spark, sf)
    return incidents.detection_latency(started, detected)


@query("regression_report", on_spans(
    f"SELECT incident_id, scope, injected_at, first_detected_at, {DETECT} AS detect_seconds, first_alert_at, {ALERT} AS alert_seconds, "
    f"coalesce({DETECT} < 300, false) AS passed FROM found", FOUND))
def regression_report(spark, sf):
    return incidents.regression_report(*incident_tables(spark, sf))


@query("latest_date_only", with_(
    "SELECT score_date, metric_type, dimension_index, round(score, 6) AS score FROM drift_table "
    "WHERE score_date = (SELECT max(score_date) FROM drift_table)", *DRIFT_TABLE_SQL))
def latest_only(spark, sf):
    return latest_date_only(drift_table(spark, sf), "score_date")
