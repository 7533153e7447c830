"""Filters, search, sort and limit."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.functions.sampling import hash_keep
from spanmill.operators import alerts, search
from spanmill.plans import derived
from spanmill.plans.catalog.alerting import HISTORY_SQL, history
from spanmill.plans.catalog.registry import query
from spanmill.plans.catalog.sql import IN_WEEK, WEEK, on_spans, with_

LISTING = (
    "trace_id, span_id, parent_span_id, service_name, span_name, span_kind, status_code, provider, model, "
    "input_tokens, output_tokens, duration_ms, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time"
)


@query("search_traces", on_spans(
    f"SELECT {LISTING} FROM spans WHERE model = 'gpt-4o' AND status_code = 'ERROR' "
    "ORDER BY spans.start_time DESC, span_id LIMIT 50 OFFSET 10"))
def search_traces(spark, sf):
    return search.search_traces(derived.spans(spark, sf), model="gpt-4o", status="ERROR", limit=50, offset=10)


@query("search_time_range", on_spans(
    f"SELECT {LISTING} FROM spans WHERE spans.start_time >= TIMESTAMP '2024-01-05 00:00:00' "
    "AND spans.start_time < TIMESTAMP '2024-01-25 00:00:00' AND provider = 'openai' ORDER BY duration_ms DESC, span_id LIMIT 50"))
def search_time_range(spark, sf):
    return search.search_time_range(
        derived.spans(spark, sf), "2024-01-05 00:00:00", "2024-01-25 00:00:00", sort="duration_ms", provider="openai")


@query("trace_spans", on_spans(f"SELECT {LISTING} FROM spans WHERE trace_id = md5('t7')"))
def trace_spans(spark, sf):
    return search.trace_spans(derived.spans(spark, sf), "3685708fd594a6861aa73f181e657dc5")


@query("distinct_models", on_spans("SELECT DISTINCT model FROM spans"))
def distinct_models(spark, sf):
    return search.distinct_models(derived.spans(spark, sf))


@query("distinct_providers", on_spans("SELECT DISTINCT provider FROM spans"))
def distinct_providers(spark, sf):
    return search.distinct_providers(derived.spans(spark, sf))


JOB_COLUMNS = ["trace_id", "span_id", "service_name", "provider", "model", "duration_ms", "start_time"]
JOB_SQL = ", ".join(JOB_COLUMNS)


@query("recent_client_spans", on_spans(
    f"SELECT {JOB_SQL} FROM spans WHERE {IN_WEEK} AND span_kind = 'CLIENT'"))
def recent_client_spans(spark, sf):
    return search.recent_client_spans(derived.spans(spark, sf), derived.AS_OF, **WEEK).select(*JOB_COLUMNS)


@query("rag_spans", on_spans(
    f"SELECT {JOB_SQL} FROM spans WHERE {IN_WEEK} AND (service_name LIKE '%langchain%' OR service_name LIKE '%llamaindex%')"))
def rag_spans(spark, sf):
    return search.rag_spans(derived.spans(spark, sf), derived.AS_OF, **WEEK).select(*JOB_COLUMNS)


@query("recent_prompts", on_spans(
    f"SELECT span_id, span_name FROM spans WHERE {IN_WEEK} AND span_kind = 'CLIENT' AND span_name <> ''"))
def recent_prompts(spark, sf):
    return search.recent_prompts(derived.spans(spark, sf), derived.AS_OF).select("span_id", "span_name")


@query("hash_sample", on_spans(
    "SELECT span_id, substr(md5(concat('score', span_id)), 1, 8) < '26666667' AS scoring, "
    "substr(md5(concat('rag', span_id)), 1, 8) < '33333334' AS rag FROM spans "
    "WHERE substr(md5(concat('x', trace_id)), 1, 8) < '1999999a'"))
def hash_sample(spark, sf):
    return search.hash_sample(derived.spans(spark, sf), "trace_id", 0.10, "x").select(
        "span_id", hash_keep("span_id", 0.15, "score").alias("scoring"), hash_keep("span_id", 0.20, "rag").alias("rag"))


@query("lookup_spans", on_spans("SELECT span_id, user_id, app_id, conversation_id, start_time FROM spans WHERE user_id = 'user-8' AND app_id = 'app-3'"))
def lookup_spans(spark, sf):
    found = search.lookup_spans(derived.spans(spark, sf), user_id="user-8", app_id="app-3")
    return found.select("span_id", "user_id", "app_id", "conversation_id", "start_time")


@query("alert_timeline", with_(
    "SELECT alert_name AS name, severity, status, description, series, "
    "strftime(history.fired_at, '%Y-%m-%d %H:%M:%S') AS fired_at, strftime(history.resolved_at, '%Y-%m-%d %H:%M:%S') AS resolved_at "
    "FROM history", *HISTORY_SQL))
def alert_timeline(spark, sf):
    return alerts.alert_timeline(history(spark, sf))


@query("active_alerts", with_(
    "SELECT alert_name AS name, severity, status, description, fired_at AS started_at FROM history WHERE resolved_at IS NULL",
    *HISTORY_SQL))
def active_alerts(spark, sf):
    return alerts.active_alerts(history(spark, sf))
