"""Personal-data scan of responses as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanmill.functions import times
from spanmill.operators import pii
from spanmill.schemas import PII_QUEUE
from spanmill.sources.facts import conform
from spanmill.streaming.ingest import FLUSH_SECONDS, start


def pii_stream(
    responses: DataFrame, path: str, checkpoint: str, as_of=None, seconds: float | None = FLUSH_SECONDS, **options
) -> StreamingQuery:
    """Append queue rows in the layout of the batch queue; stateless, so no watermark and no late data.

    Rows carry the time of their batch, or ``as_of`` in a replay.
    """
    when = F.current_timestamp() if as_of is None else times.moment(as_of)
    rows = conform(pii.triage(responses, when, **options), PII_QUEUE, when).withColumn("month", times.month_of("evaluated_at"))
    writer = rows.writeStream.format("parquet").outputMode("append").partitionBy("month").option("path", path)
    return start(writer, checkpoint, seconds)
