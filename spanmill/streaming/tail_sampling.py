"""Tail sampling on a stream, in two forms.

``tail_sample_join`` uses only built-in operators; ``tail_sample_timed`` decides a fixed
time after the first span of a trace, and remembers the decision.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanmill.functions.sampling import TRACE_RATE, hash_keep
from spanmill.streaming.ingest import WATERMARK

DECISION_MS = 10_000
DECISION_TTL_MS = 3_600_000
#: Held spans that are released together.
PIECE = 10_000

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
# With processing-time timers a query always asks for one more empty batch, so a run over
# all that is there would never stop.
ONE_SHOT_SETTINGS = {**STATE_SETTINGS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def tail_sample_join(
    spans: DataFrame, reasons: DataFrame, rate: float = TRACE_RATE, salt: str = "", delay: str = WATERMARK,
    trace_length: str = "1 hour", slow_ms: float | None = None,
) -> DataFrame:
    """Spans of kept traces, emitted as soon as a reason to keep their trace is known.

    ``spans`` and ``reasons`` are two reads of the same stream. Traces in the share are
    passed on without any state. The others wait in a stream-stream semi join for an
    error span of their trace, at most ``trace_length`` apart, after which state expires:
    choose it above the longest trace, since a span further from every error is lost.
    """
    in_share = hash_keep("trace_id", rate, salt)
    must_keep = F.col("status_code") == "ERROR"
    if slow_ms is not None:
        must_keep = must_keep | (F.col("duration_ms") > slow_ms)
    waiting = spans.filter(~in_share).withWatermark("start_time", delay)
    found = (
        reasons.filter(must_keep & ~in_share)
        .select(F.col("trace_id").alias("_trace"), F.col("start_time").alias("_seen"))
        .withWatermark("_seen", delay)
    )
    near = F.expr(
        f"trace_id = _trace AND _seen >= start_time - INTERVAL {trace_length} "
        f"AND _seen <= start_time + INTERVAL {trace_length}"
    )
    kept = waiting.join(found, near, "left_semi")
    return spans.filter(in_share).unionByName(kept)


class TraceDecision(StatefulProcessor):
    """Holds the spans of an undecided trace; emits or drops them when the timer fires.

    A trace with an error is decided at once, so a long failing trace is not held.
    """

    def __init__(self, schema: T.StructType, wait_ms: int, slow_ms: float | None):
        self.schema = schema
        self.wait_ms = wait_ms
        self.slow_ms = slow_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        decision = T.StructType([T.StructField("keep", T.BooleanType())])
        self.decision = handle.getValueState("decision", decision, DECISION_TTL_MS)

    def _must_keep(self, columns: dict[str, list]) -> bool:
        if "ERROR" in columns["status_code"]:
            return True
        return self.slow_ms is not None and any(d is not None and d > self.slow_ms for d in columns["duration_ms"])

    def _release(self) -> Iterator[pd.DataFrame]:
        """The held spans, piece by piece: a long trace is never in memory as a whole."""
        held = iter(self.held.get())
        while piece := list(islice(held, PIECE)):
            yield pd.DataFrame(piece, columns=self.schema.names)
        self.held.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A trace has few spans: plain lists cost less than operations on frames, and each call of the state a round trip.
        decided = self.decision.get()
        for batch in rows:
            columns = {name: batch[name].tolist() for name in self.schema.names}
            if decided is not None:
                if decided[0]:
                    yield batch[self.schema.names]
                continue
            if self._must_keep(columns):
                decided = (True,)
                self.decision.update(decided)
                if self.held.exists():
                    yield from self._release()
                yield batch[self.schema.names]
                continue
            if not self.held.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            self.held.appendList(list(zip(*columns.values(), strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # No reason turned up in time; traces of the share never come here.
        if not self.decision.exists():
            self.decision.update((False,))
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class RowDecision(TraceDecision):
    """The same over rows: building frames for a trace costs more than its few spans do."""

    def _release(self) -> Iterator[Row]:
        row = Row(*self.schema.names)
        for span in self.held.get():
            yield row(*span)
        self.held.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        decided = self.decision.get()
        while piece := list(islice(rows, PIECE)):
            if decided is None and self._must_keep(dict(zip(self.schema.names, zip(*piece, strict=True), strict=True))):
                decided = (True,)
                self.decision.update(decided)
                if self.held.exists():
                    yield from self._release()
            if decided is not None:
                if decided[0]:
                    yield from piece
                continue
            if not self.held.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            self.held.appendList(list(map(tuple, piece)))


def tail_sample_timed(
    spans: DataFrame, rate: float = TRACE_RATE, salt: str = "", wait_ms: int = DECISION_MS, slow_ms: float | None = None
) -> DataFrame:
    """Decide ``wait_ms`` of processing time after the first span of a trace arrived.

    Later spans follow the decision. Traces in the share need no decision and skip the
    state. Needs ``STATE_SETTINGS``; ``ONE_SHOT_SETTINGS`` when run over what is there.
    """
    in_share = hash_keep("trace_id", rate, salt)
    decided = (
        spans.filter(~in_share)
        .groupBy("trace_id")
        .transformWithState(
            statefulProcessor=RowDecision(spans.schema, wait_ms, slow_ms),
            outputStructType=spans.schema, outputMode="append", timeMode="ProcessingTime",
        )
    )
    return spans.filter(in_share).unionByName(decided)
