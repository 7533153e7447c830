"""Projections, normalisation and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.functions import labels, times
from spanmill.functions.genai import ATTRIBUTE_COLUMNS, canonical_model
from spanmill.functions.pii import TEXT_LIMIT, pii_items
from spanmill.operators import normalize
from spanmill.plans import derived
from spanmill.plans.catalog.drifting import BY_DATE_SQL, daily_drift
from spanmill.plans.catalog.registry import query
from spanmill.plans.catalog.sql import CANONICAL, on_evals, on_priced, on_spans, with_


def _with_attributes(spans):
    """Spans reduced to ids and an attribute bag as JSON text."""
    entries = []
    for column, name in ATTRIBUTE_COLUMNS.items():
        entries += [F.lit(name), F.col(column).cast("string")]
    return spans.select("span_id", F.to_json(F.create_map(*entries)).alias("attributes"))


@query("normalize_genai", on_spans(
    "SELECT span_id, provider, model, operation_name, input_tokens, output_tokens, response_id, "
    "input_tokens + output_tokens AS total_tokens FROM spans"))
def normalize_genai(spark, sf):
    bags = _with_attributes(derived.spans(spark, sf))
    return normalize.normalize_spans(bags).select(
        "span_id", "provider", "model", "operation_name", "input_tokens", "output_tokens", "response_id", "total_tokens"
    )


def _payload():
    """A response in the usage dialect of the span's provider."""
    tokens_in, tokens_out = F.col("input_tokens").cast("string"), F.col("output_tokens").cast("string")
    total = (F.col("input_tokens") + F.col("output_tokens")).cast("string")
    plain = F.concat(
        F.lit('{"usage":{"prompt_tokens":'), tokens_in, F.lit(',"completion_tokens":'), tokens_out,
        F.lit(',"total_tokens":'), total, F.lit("}}"))
    split = F.concat(F.lit('{"usage":{"input_tokens":'), tokens_in, F.lit(',"output_tokens":'), tokens_out, F.lit("}}"))
    # The third dialect leaves out the count of the candidates here: missing reads as 0.
    short = F.concat(F.lit('{"usage_metadata":{"prompt_token_count":'), tokens_in, F.lit("}}"))
    return F.when(F.col("provider") == "anthropic", split).when(F.col("provider") == "gcp.gen_ai", short).otherwise(plain)


@query("normalize_usage", on_spans(
    "SELECT span_id, input_tokens, CASE WHEN provider = 'gcp.gen_ai' THEN 0 ELSE output_tokens END AS output_tokens, "
    "input_tokens + CASE WHEN provider = 'gcp.gen_ai' THEN 0 ELSE output_tokens END AS total_tokens FROM spans"))
def normalize_usage(spark, sf):
    raw = derived.spans(spark, sf).select("span_id", _payload().alias("payload"))
    return normalize.normalize_usage(raw).drop("payload")


@query("canonical_model", on_spans(
    f"SELECT model, {CANONICAL.format('model')} AS canonical_model, count(*) AS span_count FROM spans GROUP BY model"))
def canonical(spark, sf):
    counted = derived.spans(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("span_count"))
    return counted.withColumn("canonical_model", canonical_model("model"))


@query("defaults", on_spans(
    "SELECT span_id, '' AS status_message, 0::DOUBLE AS cost_usd, '{}' AS attributes, 0::BIGINT AS total_tokens, "
    "TIMESTAMP '2024-01-31 00:00:00' AS inserted_at FROM spans"))
def defaults(spark, sf):
    full = normalize.with_defaults(derived.spans(spark, sf), derived.AS_OF)
    return full.select("span_id", "status_message", "cost_usd", "attributes", "total_tokens", "inserted_at")


@query("time_buckets", on_spans(
    "SELECT span_id, date_trunc('minute', start_time) AS minute, date_trunc('hour', start_time) AS hour, "
    "cast(start_time AS date) AS day, strftime(start_time, '%Y%m') AS month FROM spans"))
def time_buckets(spark, sf):
    return derived.spans(spark, sf).select(
        "span_id", times.minute_of("start_time").alias("minute"), times.hour_of("start_time").alias("hour"),
        times.day_of("start_time").alias("day"), times.month_of("start_time").alias("month"),
    )


@query("format_ts", on_spans(
    "SELECT span_id, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS ts_text, strftime(start_time, '%Y-%m-%d') AS date_text FROM spans"))
def format_ts(spark, sf):
    return derived.spans(spark, sf).select(
        "span_id", times.format_ts("start_time").alias("ts_text"), times.format_date("start_time").alias("date_text")
    )


@query("age_window", on_spans(
    "SELECT w.name AS window_name, count(s.span_id) AS span_count FROM spans s "
    "JOIN (VALUES ('1 hour', INTERVAL 1 HOUR), ('24 hours', INTERVAL 24 HOUR), ('7 days', INTERVAL 7 DAY), "
    "('30 days', INTERVAL 30 DAY), ('90 days', INTERVAL 90 DAY)) AS w(name, width) "
    "ON s.start_time >= TIMESTAMP '2024-01-31 00:00:00' - w.width AND s.start_time < TIMESTAMP '2024-01-31 00:00:00' "
    "GROUP BY w.name"))
def age_window(spark, sf):
    widths = {"1 hour": {"hours": 1}, "24 hours": {"hours": 24}, "7 days": {"days": 7}, "30 days": {"days": 30}, "90 days": {"days": 90}}
    one_pass = derived.spans(spark, sf).agg(
        *[F.count_if(times.within("start_time", derived.AS_OF, **w)).alias(n) for n, w in widths.items()]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("window_name"), F.col(n).alias("span_count")) for n in widths])
    return one_pass.select(F.inline(rows)).filter("span_count > 0")


@query("like_filter", on_evals(
    "SELECT metric_name, count(*) AS eval_count FROM raw_evals WHERE metric_name LIKE 'toxicity_%' GROUP BY metric_name"))
def like_filter(spark, sf):
    matching = derived.evals(spark, sf).filter(F.col("metric_name").like("toxicity_%"))
    return matching.groupBy("metric_name").agg(F.count(F.lit(1)).alias("eval_count"))


@query("severity_case", with_(
    "SELECT dim, score_date, round(psi, 6) AS psi, CASE WHEN psi > 0.25 THEN 'critical' WHEN psi > 0.2 THEN 'warning' "
    "ELSE 'normal' END AS severity FROM by_date_scores", BY_DATE_SQL))
def severity_case(spark, sf):
    return daily_drift(spark, sf).select("dim", "score_date", "psi", labels.psi_level(F.col("psi")).alias("severity"))


@query("truncate_text", "SELECT doc_id, substr(text, 1, 500) AS response_text, substr(md5(cast(doc_id AS varchar)), 1, 12) AS short_id FROM documents")
def truncate_text(spark, sf):
    return derived.table(spark, sf, "documents").select(
        "doc_id", labels.short("text", TEXT_LIMIT).alias("response_text"),
        labels.short(F.md5(F.col("doc_id").cast("string")), 12).alias("short_id"),
    )


ITEMS_SQL = (
    "list_concat(list_concat("
    "list_transform(regexp_extract_all({0}, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b'), lambda v: {{'type': 'ssn', 'value': v}}), "
    "list_transform(regexp_extract_all({0}, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b'), lambda v: {{'type': 'email', 'value': v}})), "
    "list_transform(regexp_extract_all({0}, '\\b\\d{{3}}[-.]?\\d{{3}}[-.]?\\d{{4}}\\b'), lambda v: {{'type': 'phone', 'value': v}}))"
)


@query("items_json", "SELECT doc_id, cast(to_json(" + ITEMS_SQL.format("text") + ") AS varchar) AS items FROM documents")
def items_json(spark, sf):
    return derived.table(spark, sf, "documents").select("doc_id", F.to_json(pii_items("text")).alias("items"))


@query("kpi_format", on_priced(
    "SELECT user_id, concat('$', printf('%.4f', coalesce(sum(cost_usd), 0))) AS cost_text, "
    "printf('%.2f', max(duration_ms)) AS longest_text, format('{:,}', sum(input_tokens)::BIGINT) AS tokens_text, "
    "printf('%.1f', coalesce(sum(CASE WHEN status_code = 'NONE' THEN 1.0 END), 0)) AS nothing_text FROM priced GROUP BY user_id"))
def kpi_format(spark, sf):
    return derived.priced_spans(spark, sf).groupBy("user_id").agg(
        labels.money(F.sum("cost_usd")).alias("cost_text"),
        labels.fixed(F.max("duration_ms"), 2).alias("longest_text"),
        labels.grouped(F.sum("input_tokens")).alias("tokens_text"),
        labels.fixed(F.sum(F.when(F.col("status_code") == "NONE", 1.0)), 1).alias("nothing_text"),
    )
