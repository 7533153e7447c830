"""GenAI attribute bags, usage dialects and model names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute names of the GenAI semantic conventions, per span column.
ATTRIBUTE_COLUMNS = {
    "provider": "gen_ai.provider.name",
    "model": "gen_ai.request.model",
    "operation_name": "gen_ai.operation.name",
    "input_tokens": "gen_ai.usage.input_tokens",
    "output_tokens": "gen_ai.usage.output_tokens",
    "response_id": "gen_ai.response.id",
}
TOKEN_COLUMNS = ("input_tokens", "output_tokens")

# JSON paths of the token counts in the provider responses.
USAGE_INPUT = ("$.usage.prompt_tokens", "$.usage.input_tokens", "$.usage_metadata.prompt_token_count")
USAGE_OUTPUT = ("$.usage.completion_tokens", "$.usage.output_tokens", "$.usage_metadata.candidates_token_count")
USAGE_TOTAL = ("$.usage.total_tokens", "$.usage_metadata.total_token_count")


def attribute(bag: Column, name: str) -> Column:
    """One entry of a ``map<string,string>``, null when absent."""
    return F.try_element_at(bag, F.lit(name))


def genai_columns(bag: Column) -> dict[str, Column]:
    """Typed span columns out of an attribute map; ``''`` and 0 when absent."""
    out = {}
    for column, name in ATTRIBUTE_COLUMNS.items():
        raw = attribute(bag, name)
        if column in TOKEN_COLUMNS:
            out[column] = F.coalesce(raw.try_cast("long"), F.lit(0).cast("long"))
        else:
            out[column] = F.coalesce(raw, F.lit(""))
    out["total_tokens"] = out["input_tokens"] + out["output_tokens"]
    return out


def _first_path(payload: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.get_json_object(payload, p).try_cast("long") for p in paths])


def usage_columns(payload: Column) -> dict[str, Column]:
    """Token counts of a raw response; a missing total is the sum of the other two."""
    zero = F.lit(0).cast("long")
    tokens_in = F.coalesce(_first_path(payload, USAGE_INPUT), zero)
    tokens_out = F.coalesce(_first_path(payload, USAGE_OUTPUT), zero)
    total = F.coalesce(_first_path(payload, USAGE_TOTAL), tokens_in + tokens_out)
    return {"input_tokens": tokens_in, "output_tokens": tokens_out, "total_tokens": total}


# A path in front; "-Instruct" and a date at the end.
MODEL_AFFIXES = r"(?i)^.*/|(-instruct)?(-(\d{8}|\d{4}-\d{2}-\d{2}))?$"


def canonical_model(model: str | Column) -> Column:
    """The name under which a model is priced.

    Path prefix, date suffix and ``-Instruct`` go, case goes, and a dashed minor version
    of a claude model becomes dotted; no other family is touched by the last rule.
    """
    name = F.col(model) if isinstance(model, str) else model
    name = F.lower(F.regexp_replace(name, MODEL_AFFIXES, ""))
    dotted = F.regexp_replace(name, r"^claude-(\d)-(\d)-", "claude-$1.$2-")
    return F.when(name.startswith("claude-"), dotted).otherwise(name)
