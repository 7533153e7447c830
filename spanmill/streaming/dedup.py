"""Spans that arrive more than once, stored once.

``dedup_within`` keeps the keys seen within a watermark in state: nothing is looked up, and rows later than the watermark
are dropped. ``dedup_on_insert`` looks keys up in what is stored, in the months that a batch touches, and so takes rows of
any age; its result is that of a batch ``distinct``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanmill.sources import slots
from spanmill.streaming.ingest import FLUSH_SECONDS, WATERMARK, start
from spanmill.streaming.rollups import run_id

KEYS = ("trace_id", "span_id")


def first_per_key(rows: DataFrame, keys: tuple[str, ...] = KEYS, ts: str = "start_time") -> DataFrame:
    """The earliest row of each key, all columns kept; combined map-side, so a key of very many copies stays small."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ts)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in rows.columns])


def dedup_within(spans: DataFrame, delay: str = WATERMARK, keys: tuple[str, ...] = KEYS, ts: str = "start_time") -> DataFrame:
    """The first row of each key; state of a key is dropped once the watermark is ``delay`` past it.

    A repeat that arrives later than that is a late row and dropped for its age; so is a first row that late.
    """
    return spans.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def insert_new(spans: DataFrame, path: str, slot: str, keys: tuple[str, ...] = KEYS, ts: str = "start_time") -> None:
    """Store the rows whose keys no other slot holds, under ``slot``.

    A repeat has the time of the first row, so keys are looked up in the months of the batch only, and only the key
    columns are read. Rows without a time have no month to look in: they are stored as they come.
    """
    spark = spans.sparkSession
    months = slots.months_of(spans, ts)
    stored = slots.read_slots(spark, path, spans.schema, months, without=slot).select(*keys)
    timed = spans.filter(F.col(ts).isNotNull())
    fresh = first_per_key(timed, keys, ts).join(stored, list(keys), "left_anti").select(*spans.columns)
    slots.write_slot(fresh.unionByName(spans.filter(F.col(ts).isNull())), path, slot, ts)


def dedup_on_insert(
    spans: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = KEYS, ts: str = "start_time",
    seconds: float | None = FLUSH_SECONDS,
) -> StreamingQuery:
    """Store each key of a stream once. A batch that is run again after a failure replaces its own slot."""
    run = run_id(spans.sparkSession, checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        insert_new(batch, path, f"{run}-{batch_id}", keys, ts)

    return start(spans.writeStream.foreachBatch(store), checkpoint, seconds)


def read_deduped(spark: SparkSession, path: str, schema) -> DataFrame:
    return slots.read_slots(spark, path, schema)
