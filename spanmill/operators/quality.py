"""Checks on the span table; each returns its findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Providers that have to show up, allowed models by provider, least counts.
EXPECTED_PROVIDERS = ["openai", "anthropic", "gcp.gen_ai", "langchain", "llamaindex", "vllm"]
MODEL_RULES = {
    "openai": "^gpt-4o(-mini)?$",
    "anthropic": "claude",
    "vllm": "(?i)llama|vllm",
}
MIN_PER_PROVIDER = 1
MIN_TOTAL = 30


def valid_trace_id(trace_id: str = "trace_id") -> Column:
    return F.col(trace_id).rlike("^[0-9a-fA-F]{32,}$")


def span_quality(spans: DataFrame) -> DataFrame:
    """Per provider: rows, malformed trace ids, spans without tokens."""
    return spans.groupBy("provider").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(~valid_trace_id()).alias("bad_trace_ids"),
        F.count_if(F.col("input_tokens") <= 0).alias("no_input_tokens"),
        F.count_if(F.col("output_tokens") <= 0).alias("no_output_tokens"),
    )


def _expected(spans: DataFrame, providers: list[str]) -> DataFrame:
    rows = ", ".join(f"('{p}')" for p in providers)
    return spans.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(provider)")


def missing_providers(spans: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Expected providers without a single span."""
    seen = spans.select("provider").distinct()
    return _expected(spans, expected or EXPECTED_PROVIDERS).join(seen, "provider", "left_anti")


def provider_model_rules(spans: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Per provider with a rule: spans, and spans whose model breaks it."""
    rules = rules or MODEL_RULES
    pattern_ok = F.lit(True)
    for provider, pattern in rules.items():
        pattern_ok = F.when(F.col("provider") == provider, F.col("model").rlike(pattern)).otherwise(pattern_ok)
    return (
        spans.filter(F.col("provider").isin(*rules))
        .groupBy("provider")
        .agg(F.count(F.lit(1)).alias("span_count"), F.count_if(~pattern_ok).alias("bad_models"))
    )


def orphan_spans(spans: DataFrame) -> DataFrame:
    """Spans naming a parent that their trace does not hold."""
    ids = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    named = spans.filter(F.col("parent_span_id") != "")
    return named.join(ids, ["trace_id", "parent_span_id"], "left_anti").select(
        "trace_id", "span_id", "parent_span_id", "service_name"
    )


def parent_share(spans: DataFrame) -> DataFrame:
    """Per service: share of spans that name a parent."""
    with_parent = F.count_if(F.col("parent_span_id") != "")
    return spans.groupBy("service_name").agg(
        F.count(F.lit(1)).alias("span_count"),
        with_parent.alias("with_parent"),
        (with_parent / F.count(F.lit(1))).alias("parent_share"),
    )


def cyclic_spans(depths: DataFrame) -> DataFrame:
    """Spans the depth search left open, which lie on or under a cycle."""
    return depths.filter(F.col("depth").isNull()).select("trace_id", "span_id")


def min_span_count(
    spans: DataFrame, per_provider: int = MIN_PER_PROVIDER, total: int = MIN_TOTAL,
    expected: list[str] | None = None,
) -> DataFrame:
    """Counts against their minimum, per expected provider and in total."""
    counts = spans.groupBy("provider").agg(F.count(F.lit(1)).alias("span_count"))
    each = (
        _expected(spans, expected or EXPECTED_PROVIDERS)
        .join(counts, "provider", "left")
        .select(
            F.col("provider").alias("scope"),
            F.coalesce("span_count", F.lit(0).cast("long")).alias("span_count"),
            F.lit(per_provider).cast("long").alias("minimum"),
        )
    )
    everything = counts.agg(F.coalesce(F.sum("span_count"), F.lit(0)).alias("span_count")).select(
        F.lit("total").alias("scope"), "span_count", F.lit(total).cast("long").alias("minimum")
    )
    return each.unionByName(everything).withColumn("enough", F.col("span_count") >= F.col("minimum"))
