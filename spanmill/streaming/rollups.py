"""Live rollups.

Two forms. ``*_on_insert`` keeps the partial rollup of every batch and merges at read
time: no state, nothing is ever late, and what is read is always complete; ``merge_*`` jobs
bring stored batches together by day (see ``merging``). ``*_windows``
keeps open windows in state and emits each once, after the watermark has passed it; rows
later than that are dropped, to be repaired by a batch rollup.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanmill.functions import times
from spanmill.operators.rollups import (
    eval_daily, merge_eval_daily, merge_rollup, rollup_aggregates, rollup_minute, with_p95,
)
from spanmill.session import settings
from spanmill.streaming.ingest import FLUSH_SECONDS, WATERMARK, start
from spanmill.streaming.merging import merge_partials, on_day, read_merged


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that ``checkpoint`` belongs to, made at its first start and kept beside it."""
    path = f"{checkpoint.rstrip('/')}-run"
    made = spark.range(1).select(F.lit(uuid.uuid4().hex).alias("run"))
    made.write.mode("ignore").json(path)
    return spark.read.schema("run string").json(path).first()["run"]


def write_partials(
    stream: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
    seconds: float | None = FLUSH_SECONDS, at: Column | None = None,
) -> StreamingQuery:
    """Store ``partial(batch)`` under the stream's id and the batch's number, by the day of ``at``.

    A batch that is run again after a failure replaces its own folder, so partials count once. Batch numbers begin
    anew with a new checkpoint; the id keeps such a stream, and any other that stores under ``path``, apart.
    """
    run = run_id(stream.sparkSession, checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = partial(batch)
        rows = rows.withColumn("on_day", on_day(at))
        rows.write.mode("overwrite").partitionBy("on_day").parquet(f"{path}/run={run}/batch={batch_id}")

    return start(stream.writeStream.foreachBatch(store), checkpoint, seconds)


def read_partials(spark: SparkSession, path: str, since=None) -> DataFrame:
    """All stored partials, or with ``since`` those of its day and later; older folders are not read.

    Days that ``merge_partials`` has merged come from their merged folder, later batches from their own.
    """
    day = None
    if since is not None:
        day = spark.range(1).select(on_day(times.moment(since)).alias("day")).first()["day"]
    merged = read_merged(spark, path, day)
    if merged is not None:
        return merged
    # Ids and days are texts, also where all of them look like numbers or dates.
    with settings(spark, {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}):
        rows = spark.read.parquet(path)
    if day is not None:
        rows = rows.filter(F.col("on_day") >= day)
    return rows.drop("run", "batch", "on_day")


def rollup_on_insert(spans: DataFrame, path: str, checkpoint: str, seconds: float | None = FLUSH_SECONDS) -> StreamingQuery:
    return write_partials(spans, rollup_minute, path, checkpoint, seconds, F.col("minute"))


def read_rollup(spark: SparkSession, path: str, since=None) -> DataFrame:
    """The minute rollup as of the last stored batch, or its days from ``since`` on."""
    return merge_rollup("minute", read_partials(spark, path, since))


def merge_stored_rollup(spark: SparkSession, path: str) -> list[str]:
    """Merge the stored batches of ``rollup_on_insert`` by day; run it every hour or so beside the stream."""
    return merge_partials(spark, path, lambda parts: merge_rollup("minute", parts), F.col("minute"))


def eval_rollup_on_insert(evals: DataFrame, path: str, checkpoint: str, seconds: float | None = FLUSH_SECONDS) -> StreamingQuery:
    """Counts every insert: a score that is replaced later has been counted by then."""
    return write_partials(evals, eval_daily, path, checkpoint, seconds, F.col("day"))


def read_eval_rollup(spark: SparkSession, path: str, since=None) -> DataFrame:
    return merge_eval_daily(read_partials(spark, path, since))


def merge_stored_eval_rollup(spark: SparkSession, path: str) -> list[str]:
    return merge_partials(spark, path, merge_eval_daily, F.col("day"))


def rollup_windows(spans: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """The minute rollup as an append-only stream of closed minutes."""
    return with_p95(
        spans.withWatermark("start_time", delay)
        .groupBy(F.window("start_time", "1 minute").alias("_w"), "provider", "model")
        .agg(*rollup_aggregates())
        .withColumn("minute", F.col("_w.start"))
        .drop("_w")
    )


def eval_windows(evals: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """The eval rollup as an append-only stream of closed days."""
    return (
        evals.withWatermark("evaluated_at", delay)
        .groupBy(F.window("evaluated_at", "1 day").alias("_w"), "evaluated_model", "metric_name")
        .agg(
            F.count(F.lit(1)).alias("eval_count"), F.sum("score").alias("total_score"),
            F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        )
        .withColumn("day", F.to_date("_w.start"))
        .drop("_w")
    )
