"""Raw spans to the span table's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.functions.genai import genai_columns, usage_columns
from spanmill.schemas import SPANS
from spanmill.sources.facts import conform


def normalize_spans(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Fill the GenAI columns from the attribute bag (JSON text or a map)."""
    bag = F.col(attributes)
    if dict(df.dtypes)[attributes] == "string":
        bag = F.from_json(bag, "map<string,string>")
    return df.withColumns(genai_columns(bag))


def normalize_usage(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Token columns from a raw response, whatever its usage dialect."""
    return df.withColumns(usage_columns(F.col(payload)))


def with_defaults(df: DataFrame, as_of=None) -> DataFrame:
    """The full span row; absent columns and null values get the table's defaults."""
    full = conform(df, SPANS, as_of)
    empty = {
        f.name: ("{}" if f.name == "attributes" else "")
        for f in SPANS.fields
        if f.dataType.simpleString() == "string"
    }
    zero = {f.name: 0 for f in SPANS.fields if f.dataType.simpleString() in ("bigint", "double")}
    return full.fillna({**empty, **zero})
