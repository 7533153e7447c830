"""The price list of the models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanmill.schemas import PRICING

# Model, provider, USD per 1000 input tokens, USD per 1000 output tokens.
SEED = [
    ("gpt-4o", "openai", 0.00250, 0.01000),
    ("gpt-4o-mini", "openai", 0.00015, 0.00060),
    ("gpt-4-turbo", "openai", 0.01000, 0.03000),
    ("gpt-3.5-turbo", "openai", 0.00050, 0.00150),
    ("o1", "openai", 0.01500, 0.06000),
    ("o1-mini", "openai", 0.00300, 0.01200),
    ("claude-3.5-sonnet", "anthropic", 0.00300, 0.01500),
    ("claude-3.5-haiku", "anthropic", 0.00025, 0.00125),
    ("claude-3-opus", "anthropic", 0.01500, 0.07500),
    ("claude-3-sonnet", "anthropic", 0.00300, 0.01500),
    ("claude-3-haiku", "anthropic", 0.00025, 0.00125),
    ("gemini-1.5-pro", "gcp.gen_ai", 0.00125, 0.00500),
    ("gemini-1.5-flash", "gcp.gen_ai", 0.000075, 0.00030),
    ("gemini-2.0-flash", "gcp.gen_ai", 0.00010, 0.00040),
    ("gemini-2.5-pro", "gcp.gen_ai", 0.00125, 0.01000),
    ("gemini-2.5-flash", "gcp.gen_ai", 0.00015, 0.00060),
    ("llama-3.1-8b", "vllm", 0.00000, 0.00000),
    ("llama-3.1-70b", "vllm", 0.00000, 0.00000),
    ("llama-3.1-405b", "vllm", 0.00000, 0.00000),
    ("mixtral-8x7b", "vllm", 0.00000, 0.00000),
]
SEED_UPDATED_AT = "2024-01-01 00:00:00"


def seed_pricing(spark: SparkSession) -> DataFrame:
    """The seed as a VALUES relation, whose exact size the optimizer knows.

    That makes Spark's own broadcast threshold the size check of every join with it.
    """
    rows = ", ".join(f"('{m}', '{p}', {i!r}D, {o!r}D)" for m, p, i, o in SEED)
    return spark.sql(
        "SELECT model_name, provider, input_cost_per_1k, output_cost_per_1k, 'USD' AS currency, "
        f"TIMESTAMP '{SEED_UPDATED_AT}' AS updated_at "
        f"FROM VALUES {rows} AS t(model_name, provider, input_cost_per_1k, output_cost_per_1k)"
    )


def read_pricing(spark: SparkSession, path: str) -> DataFrame:
    """A maintained price list from CSV with a header line."""
    return spark.read.schema(PRICING).option("header", True).csv(path)
