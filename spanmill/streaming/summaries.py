"""Trace summaries of a stream: partial summaries and edges of every batch, merged at read time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanmill.functions import times
from spanmill.operators import summaries
from spanmill.streaming.ingest import FLUSH_SECONDS, start
from spanmill.streaming.rollups import read_partials, run_id


def summarise_on_insert(spans: DataFrame, path: str, checkpoint: str, seconds: float | None = FLUSH_SECONDS) -> StreamingQuery:
    """Store the parts of every batch under the stream's id and the batch's number, by the day of the spans.

    No state is held and nothing is late; a batch that is run again replaces its own folders.
    """
    run = run_id(spans.sparkSession, checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("on_day", F.date_format("start_time", times.DATE_FORMAT))
        parts = {"parts": summaries.partial_summary(dated, "on_day"), "edges": summaries.edges(dated, "on_day")}
        for name, rows in parts.items():
            rows.write.mode("overwrite").partitionBy("on_day").parquet(f"{path}/{name}/run={run}/batch={batch_id}")

    return start(spans.writeStream.foreachBatch(store), checkpoint, seconds)


def read_summaries(spark: SparkSession, path: str, since=None) -> DataFrame:
    """One row per trace as of the last stored batch; with ``since``, of the spans of its day and later."""
    merged = summaries.merge_summaries(read_partials(spark, f"{path}/parts", since))
    return summaries.finished(merged, read_partials(spark, f"{path}/edges", since))
