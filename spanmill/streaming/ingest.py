"""Reading span files as a stream and appending them in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from spanmill.functions import times

FLUSH_SECONDS = 5
WATERMARK = "10 minutes"


def stream_files(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1000) -> DataFrame:
    """Parquet files as a stream; ``max_files`` per batch is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def start(writer: DataStreamWriter, checkpoint: str, seconds: float | None = FLUSH_SECONDS) -> StreamingQuery:
    """Start every ``seconds``, or with None over all that is there and then stop.

    The second form is how the periodic jobs run: an outside scheduler starts them, and
    the checkpoint tells what is new.
    """
    writer = writer.option("checkpointLocation", checkpoint)
    if seconds is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def batched_append(
    spans: DataFrame, path: str, checkpoint: str, ts: str = "start_time", seconds: float | None = FLUSH_SECONDS
) -> StreamingQuery:
    """Append span batches under their month folder, flushed every 5 seconds."""
    rows = spans.withColumn("month", times.month_of(ts))
    writer = rows.writeStream.format("parquet").outputMode("append").partitionBy("month").option("path", path)
    return start(writer, checkpoint, seconds)


def debug_sink(spans: DataFrame, checkpoint: str, rows: int = 20, seconds: float | None = FLUSH_SECONDS) -> StreamingQuery:
    """Print the first rows of each batch."""
    writer = spans.writeStream.format("console").option("numRows", rows).option("truncate", False)
    return start(writer, checkpoint, seconds)
