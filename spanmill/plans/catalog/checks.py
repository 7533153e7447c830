"""Data-quality checks."""

from __future__ import annotations

from spanmill.operators import quality, trees
from spanmill.plans import derived
from spanmill.plans.catalog.registry import query
from spanmill.plans.catalog.sql import on_spans


@query("span_quality", on_spans(
    "SELECT provider, count(*) AS span_count, count(*) FILTER (NOT regexp_full_match(trace_id, '[0-9a-fA-F]{32,}')) AS bad_trace_ids, "
    "count(*) FILTER (input_tokens <= 0) AS no_input_tokens, count(*) FILTER (output_tokens <= 0) AS no_output_tokens FROM spans GROUP BY 1"))
def span_quality(spark, sf):
    return quality.span_quality(derived.spans(spark, sf))


EXPECTED = quality.EXPECTED_PROVIDERS + ["mistral"]
EXPECTED_SQL = "(VALUES " + ", ".join(f"('{p}')" for p in EXPECTED) + ") AS e(provider)"


@query("missing_providers", on_spans(f"SELECT provider FROM {EXPECTED_SQL} WHERE provider NOT IN (SELECT provider FROM spans)"))
def missing_providers(spark, sf):
    return quality.missing_providers(derived.spans(spark, sf), EXPECTED)


@query("provider_model_rules", on_spans(
    "SELECT provider, count(*) AS span_count, count(*) FILTER (NOT CASE provider WHEN 'openai' THEN model IN ('gpt-4o', 'gpt-4o-mini') "
    "WHEN 'anthropic' THEN model LIKE '%claude%' ELSE lower(model) LIKE '%llama%' OR lower(model) LIKE '%vllm%' END) AS bad_models "
    "FROM spans WHERE provider IN ('openai', 'anthropic', 'vllm') GROUP BY 1"))
def provider_model_rules(spark, sf):
    return quality.provider_model_rules(derived.spans(spark, sf))


@query("orphan_spans", on_spans(
    "SELECT trace_id, span_id, parent_span_id, service_name FROM torn s WHERE parent_span_id <> '' AND NOT EXISTS "
    "(SELECT 1 FROM torn p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_span_id)",
    f"torn AS (SELECT * REPLACE ({derived.TORN_TRACE} AS trace_id) FROM spans)"))
def orphan_spans(spark, sf):
    """On all spans, of which some come under a trace id of their own."""
    return quality.orphan_spans(derived.torn_spans(spark, sf))


@query("parent_share", on_spans(
    "SELECT service_name, count(*) AS span_count, count(*) FILTER (parent_span_id <> '') AS with_parent, "
    "round(count(*) FILTER (parent_span_id <> '') / count(*), 12) AS parent_share FROM spans GROUP BY 1"), digits=12)
def parent_share(spark, sf):
    return quality.parent_share(derived.spans(spark, sf))


@query("cyclic_spans", on_spans("SELECT trace_id, span_id FROM spans WHERE false"))
def cyclic_spans(spark, sf):
    return quality.cyclic_spans(trees.span_depth(derived.spans(spark, sf)))


@query("min_span_count", on_spans(
    "SELECT scope, n AS span_count, minimum, n >= minimum AS enough FROM (SELECT e.provider AS scope, count(s.span_id) AS n, 1::BIGINT AS minimum "
    f"FROM {EXPECTED_SQL} LEFT JOIN spans s ON s.provider = e.provider GROUP BY 1 UNION ALL SELECT 'total', count(*), 30 FROM spans)"))
def min_span_count(spark, sf):
    return quality.min_span_count(derived.spans(spark, sf), expected=EXPECTED)
