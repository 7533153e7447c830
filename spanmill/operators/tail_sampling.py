"""Keep whole traces: those with an error, slow ones if asked, and a share of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.functions.sampling import TRACE_RATE, hash_keep
from spanmill.operators.skew import join_per_key

SLOW_MS = 5000.0


def tail_sample(
    spans: DataFrame, rate: float = TRACE_RATE, salt: str = "", slow_ms: float | None = None
) -> DataFrame:
    """All spans of the kept traces.

    The share is decided by the trace id alone. Verdicts per trace are an aggregate
    (combined before the shuffle) joined back to the spans, so that a trace with very
    many spans is not gathered in one task.
    """
    must_keep = F.col("status_code") == "ERROR"
    if slow_ms is not None:
        must_keep = must_keep | (F.col("duration_ms") > slow_ms)
    verdicts = spans.groupBy("trace_id").agg(
        F.max(must_keep).alias("_must"), F.count(F.lit(1)).alias("key_rows")
    )
    kept = F.col("_must") | hash_keep("trace_id", rate, salt)
    return join_per_key(spans, verdicts, ["trace_id"], spread_on="span_id", how="left_semi", match=kept)
