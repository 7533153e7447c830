"""Table schemas. ``''`` and 0 stand for missing; only ``resolved_at`` is ever null."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

SPANS = _schema(
    trace_id=_S, span_id=_S, parent_span_id=_S,
    service_name=_S, span_name=_S, span_kind=_S, status_code=_S, status_message=_S,
    provider=_S, model=_S, operation_name=_S,
    input_tokens=_L, output_tokens=_L, total_tokens=_L,
    response_id=_S, user_id=_S, app_id=_S, conversation_id=_S,
    start_time=_TS, end_time=_TS, duration_ms=_D, cost_usd=_D,
    attributes=_S, inserted_at=_TS,
)

EVALS = _schema(
    trace_id=_S, span_id=_S, parent_span_id=_S,
    metric_name=_S, score=_D, reason=_S, model_used=_S,
    evaluated_provider=_S, evaluated_model=_S,
    evaluated_at=_TS, inserted_at=_TS,
)

DRIFT_SCORES = _schema(
    score_date=T.DateType(), metric_type=_S, dimension_index=T.IntegerType(), score=_D,
    n_current=_L, enough=T.BooleanType(), baseline_period=_S, current_period=_S, inserted_at=_TS,
)

ALERT_HISTORY = _schema(
    alert_name=_S, severity=_S, status=_S, description=_S,
    fired_at=_TS, resolved_at=_TS, inserted_at=_TS,
)

PII_QUEUE = _schema(
    trace_id=_S, score=_D, detected_items=_S, response_text=_S,
    evaluated_at=_TS, resolved=T.BooleanType(), inserted_at=_TS,
)

PRICING = _schema(
    model_name=_S, provider=_S, input_cost_per_1k=_D, output_cost_per_1k=_D,
    currency=_S, updated_at=_TS,
)

# Time column, and days a row is kept, per table (fixed values).
RETENTION = {
    "spans": ("start_time", 90),
    "evals": ("evaluated_at", 90),
    "pii_queue": ("evaluated_at", 90),
    "drift_scores": ("score_date", 365),
    "alert_history": ("fired_at", 180),
}
