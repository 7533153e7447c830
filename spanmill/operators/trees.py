"""Trace trees: depth of every span, and the waterfall view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.functions import times
from spanmill.operators.skew import join_per_key
from spanmill.session import counted_copy, cut_lineage

MIN_BAR_PERCENT = 2.0


def _parent_depths(nodes: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth, key_rows) of every span that others of ``nodes`` name as parent, with their number.

    A parent that its trace does not hold has depth -1, so that its children are roots; on or under a cycle depth is null.
    A parent's own parent is in the same table, so the search meets parents only. Every round writes the parents that
    are still open, and reads the settled ones from where earlier rounds left them.
    """
    named = nodes.filter(F.col("parent_span_id") != "").groupBy("trace_id", F.col("parent_span_id").alias("span_id"))
    inner = named.agg(F.count(F.lit(1)).alias("key_rows")).join(
        nodes.withColumnRenamed("parent_span_id", "_above"), ["trace_id", "span_id"], "left"
    )
    up = F.when(F.col("_above") != "", F.col("_above"))
    depth = F.when(F.col("_above").isNull(), -1).when(F.col("_above") == "", 0).otherwise(1)
    pending = F.col("up").isNotNull()
    rows, _, open_spans = counted_copy(inner.select("trace_id", "span_id", "key_rows", up.alias("up"), depth.alias("depth")), pending)
    settled = rows.filter(~pending)
    while open_spans:
        left = rows.filter(pending)
        target = settled.unionByName(left).select(
            "trace_id", F.col("span_id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth")
        )
        moved = left.join(target, ["trace_id", "up"]).select(
            "trace_id", "span_id", "key_rows", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth")
        )
        rows, _, still_open = counted_copy(moved, pending)
        settled = settled.unionByName(rows.filter(~pending))
        if still_open == open_spans:
            settled = settled.unionByName(rows.filter(pending).withColumn("depth", F.lit(None).cast("int")))
            break
        open_spans = still_open
    return settled.select("trace_id", "span_id", "depth", "key_rows")


def span_depth(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth) for all traces at once.

    A span without a parent in its trace is a root of depth 0. Pointer doubling: every
    parent points to an ancestor ``depth`` levels up (null once it has passed a root), and
    each round replaces the pointer by the pointer of the span it points to, so a tree of
    depth d takes about log2(d) rounds. When a round settles no span, all that are left
    lie on or under a cycle; they get a null depth. Spans are one deeper than their parent;
    the children of one that has very many are spread for that. A span without a trace id is a root.
    """
    parent = F.coalesce("parent_span_id", F.lit("")).alias("parent_span_id")
    # A span that is there twice has its smallest parent, whatever the order of rows.
    nodes = cut_lineage(spans.select("trace_id", "span_id", parent).groupBy("trace_id", "span_id").agg(F.min("parent_span_id").alias("parent_span_id")))
    above = _parent_depths(nodes).select(
        "trace_id", F.col("span_id").alias("parent_span_id"), "key_rows", (F.col("depth") + 1).alias("depth"), F.lit(True).alias("_named")
    )
    roots = nodes.filter(F.col("parent_span_id") == "").select("trace_id", "span_id", F.lit(0).alias("depth"))
    children = join_per_key(nodes.filter(F.col("parent_span_id") != ""), above, ["trace_id", "parent_span_id"], spread_on="span_id")
    return roots.unionByName(children.select("trace_id", "span_id", F.when(F.col("_named"), F.col("depth")).otherwise(0).alias("depth")))


def waterfall(spans: DataFrame, trace_id: str | None = None) -> DataFrame:
    """Spans with depth and bar width in percent of the longest span of their trace.

    The longest span comes from an aggregate per trace, not from a window over it: a
    trace with very many spans is neither sorted nor held in one task. Rows of one
    trace that is asked for are sorted; those of all traces within their partition only.
    """
    if trace_id is not None:
        spans = spans.filter(F.col("trace_id") == trace_id)
    longest = spans.groupBy("trace_id").agg(
        F.greatest(F.max("duration_ms"), F.lit(1.0)).alias("_longest"), F.count(F.lit(1)).alias("key_rows")
    )
    placed = spans.join(span_depth(spans), ["trace_id", "span_id"])
    bars = join_per_key(placed, longest, ["trace_id"], spread_on="span_id")
    percent = F.col("duration_ms") / F.col("_longest") * 100
    rows = bars.select(
        "trace_id", "span_id", "parent_span_id", "span_name", "provider", "model", "status_code",
        "depth", "start_time", "duration_ms",
        F.greatest(percent, F.lit(MIN_BAR_PERCENT)).alias("width_pct"),
        "input_tokens", "output_tokens",
    )
    order = ["trace_id", F.col("depth").asc_nulls_last(), "start_time", "span_id"]
    return rows.sortWithinPartitions(*order) if trace_id is None else rows.orderBy(*order)


def format_waterfall(bars: DataFrame) -> DataFrame:
    """The waterfall with its start time as text."""
    return bars.withColumn("start_time", times.format_ts("start_time"))
