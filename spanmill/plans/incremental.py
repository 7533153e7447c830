"""Scoring that is driven by new data: every span is scored once, whatever windows overlap and whatever runs again.

Scores lie in slots, one for each window or micro-batch, under the month of the **span's** time. A run scores the spans
that no other slot has a row for, in the months it touches, and replaces its own slot. A metric that gave no score is
stored too, as a null, so that it is not tried again by every later window; ``retry`` tries those again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spanmill.functions import times
from spanmill.operators import scoring
from spanmill.operators.evals import unevaluated_spans
from spanmill.operators.latest import latest_per_key
from spanmill.sources import slots
from spanmill.streaming.ingest import FLUSH_SECONDS, start
from spanmill.streaming.rollups import run_id

SCORES = T.StructType([
    T.StructField(name, kind) for name, kind in (
        ("trace_id", T.StringType()), ("span_id", T.StringType()), ("parent_span_id", T.StringType()), ("metric_name", T.StringType()),
        ("score", T.DoubleType()), ("error", T.StringType()), ("evaluated_provider", T.StringType()), ("evaluated_model", T.StringType()),
        ("reason", T.StringType()), ("model_used", T.StringType()), ("evaluated_at", T.TimestampType()), ("span_time", T.TimestampType()),
    )
])


def score_new(
    spans: DataFrame, path: str, slot: str, as_of, scorers: dict[str, Column], ts: str = "start_time", retry: bool = False
) -> None:
    """Score the spans of a window or batch that nothing else has scored, and store them as ``slot``."""
    spark = spans.sparkSession
    done = slots.read_slots(spark, path, SCORES, slots.months_of(spans, ts), without=slot)
    if retry:
        done = done.filter(F.col("score").isNotNull())
    # A span that stands twice in the window is scored once.
    fresh = unevaluated_spans(latest_per_key(spans, ["trace_id", "span_id"], ts), done)
    timed = fresh.select("trace_id", "span_id", F.col(ts).alias("span_time"))
    scores = scoring.score_responses(fresh, scorers, as_of).join(timed, ["trace_id", "span_id"])
    slots.write_slot(scores.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCORES]), path, slot, "span_time")


def score_window(spans: DataFrame, path: str, as_of, scorers: dict[str, Column], ts: str = "start_time", retry: bool = False, **width: int) -> None:
    """The periodic form: the last 15 minutes (or ``width``) before ``as_of``; windows may overlap, and may run again."""
    width = width or {"minutes": 15}
    recent = spans.filter(times.within(ts, as_of, **width))
    name = "-".join(f"{unit}{n}" for unit, n in sorted(width.items()))
    when = spans.sparkSession.range(1).select(F.date_format(times.moment(as_of), "yyyyMMddHHmmss")).first()[0]
    score_new(recent, path, f"window-{when}-{name}", as_of, scorers, ts, retry)


def micro_batch_jobs(
    stream: DataFrame, path: str, checkpoint: str, scorers: dict[str, Column], as_of=None, ts: str = "start_time",
    seconds: float | None = FLUSH_SECONDS, then: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """The checkpoint-driven form: every micro-batch of spans is scored as it comes, late rows too.

    Rows carry the time of their batch, or ``as_of`` in a replay. ``then`` runs after the scores of a batch are stored
    (a further job over the same rows, itself safe to run again).
    """
    run = run_id(stream.sparkSession, checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        when = F.current_timestamp() if as_of is None else as_of
        score_new(batch, path, f"{run}-{batch_id}", when, scorers, ts)
        if then is not None:
            then(batch, batch_id)

    return start(stream.writeStream.foreachBatch(store), checkpoint, seconds)


def read_scores(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Stored scores (those that failed have none), from the month of ``since`` on if given."""
    rows = slots.read_slots(spark, path, SCORES)
    if since is not None:
        rows = rows.filter(F.col("span_time") >= times.moment(since))
    return rows.filter(F.col("score").isNotNull()).drop("error")
