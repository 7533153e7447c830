"""One row for each trace, from parts that add up.

``partial_summary`` of any batch of spans is one row per trace; ``merge_summaries`` adds parts of several batches. Depth is
not a sum: a parent may come in another batch than its child. So the parts travel with the batch's edges (trace, span,
parent), and depth is taken from all edges once they are read.

Both are aggregates that combine map-side, so a trace with very many spans is never gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.operators.trees import span_depth

SUMS = ["span_count", "error_count", "input_tokens", "output_tokens", "unpriced_spans"]
_ROOT = "struct<root_start:timestamp,span_id:string,root_name:string,service_name:string,provider:string,model:string>"


def partial_summary(spans: DataFrame, *keys: str) -> DataFrame:
    """Per trace (and ``keys``): counts, tokens, cost, first start, last end, and the earliest span without a parent.

    Spans without times or durations count as the others; they move neither end. ``total_cost`` is the sum of the priced
    spans, and ``unpriced_spans`` tells how many are not in it.
    """
    is_root = F.coalesce(F.col("parent_span_id"), F.lit("")) == ""
    root = F.struct(
        F.col("start_time").alias("root_start"), "span_id", F.col("span_name").alias("root_name"), "service_name", "provider", "model"
    ).cast(_ROOT)
    ended = F.timestamp_micros(F.unix_micros("start_time") + F.round(F.coalesce("duration_ms", F.lit(0.0)) * 1000).cast("long"))
    return spans.groupBy("trace_id", *keys).agg(
        F.count(F.lit(1)).alias("span_count"),
        F.count_if(F.col("status_code") == "ERROR").alias("error_count"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_spans"),
        # Decimal sums do not depend on the order in which batches are added.
        F.coalesce(F.sum(F.col("cost_usd").cast("decimal(28,12)")), F.lit(0).cast("decimal(38,12)")).alias("total_cost"),
        F.min("start_time").alias("first_start"),
        F.max(ended).alias("last_end"),
        F.min(F.when(is_root, root)).alias("root"),
    )


def edges(spans: DataFrame, *keys: str) -> DataFrame:
    return spans.select("trace_id", "span_id", "parent_span_id", *keys)


def merge_summaries(*parts: DataFrame) -> DataFrame:
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy("trace_id").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.sum("total_cost").alias("total_cost"),
        F.min("first_start").alias("first_start"), F.max("last_end").alias("last_end"), F.min("root").alias("root"),
    )


def finished(summary: DataFrame, links: DataFrame) -> DataFrame:
    """The list page's row: the merged parts, the depth of the trace, its status and length."""
    depth = span_depth(links).groupBy("trace_id").agg(F.max("depth").alias("max_depth"))
    status: Column = F.when(F.col("error_count") > 0, "ERROR").otherwise("OK")
    length = (F.unix_micros("last_end") - F.unix_micros("first_start")) / 1000.0
    return summary.join(depth, "trace_id", "left").select(
        "trace_id", F.col("root.root_name").alias("root_name"), F.col("root.service_name").alias("service_name"),
        F.col("root.provider").alias("provider"), F.col("root.model").alias("model"), status.alias("status_code"),
        "span_count", "error_count", "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.col("total_cost").cast("double").alias("total_cost"), "unpriced_spans", "first_start", "last_end", length.alias("duration_ms"), "max_depth",
    )


def trace_summary(spans: DataFrame) -> DataFrame:
    """One row per trace of ``spans``: root, status, counts, tokens, cost, first start, last end, length and depth.

    A trace whose root is missing has a null root; one that lies wholly on a cycle a null depth. Spans that stand twice
    count twice (deduplicate first).
    """
    return finished(partial_summary(spans), edges(spans))
