"""Streams against the batch form of the same operator, with input in several files."""

from pathlib import Path

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.operators import rollups as batch
from spanmill.operators.normalize import with_defaults
from spanmill.operators.tail_sampling import tail_sample
from spanmill.plans.catalog import streams
from spanmill.schemas import SPANS
from spanmill.session import settings, work_path
from spanmill.streaming import ingest, rollups
from spanmill.streaming import tail_sampling
from spanmill.streaming.tail_sampling import ONE_SHOT_SETTINGS, tail_sample_join, tail_sample_timed

AS_OF = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def files(spark):
    """Four files written one after the other in time order, and the spans in them."""
    spans = spark.range(400).select(
        F.format_string("%016x", "id").alias("span_id"),
        F.md5((F.floor(F.col("id") / 4)).cast("string")).alias("trace_id"),
        F.when(F.col("id") % 29 == 0, "ERROR").otherwise("OK").alias("status_code"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 20).alias("start_time"),
        (F.col("id") % 90 + 1).cast("double").alias("duration_ms"),
        F.lit("openai").alias("provider"), F.lit("gpt-4o").alias("model"),
        F.lit(10).alias("input_tokens"), F.lit(5).alias("output_tokens"), F.col("id"),
    )
    path = work_path(spark, "replay")
    for part in range(4):
        rows = with_defaults(spans.filter(F.floor(F.col("id") / 100) == part), AS_OF)
        rows.coalesce(1).write.mode("append").parquet(path)
    return path


def replay(spark, files):
    return ingest.stream_files(spark, files, SPANS, max_files=1)


def finish(spark, frame, name):
    path, checkpoint = work_path(spark, name), work_path(spark, name + "-checkpoint")
    writer = frame.writeStream.format("parquet").outputMode("append").option("path", path)
    ingest.start(writer, checkpoint, seconds=None).awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


def test_rollup_on_insert_equals_batch(spark, files):
    path, checkpoint = work_path(spark, "live"), work_path(spark, "live-checkpoint")
    rollups.rollup_on_insert(replay(spark, files), path, checkpoint, seconds=None).awaitTermination()
    assert spark.read.parquet(path).select("batch").distinct().count() == 4
    shown = ["minute", "span_count", "total_tokens", "error_count", "p95_latency_ms"]
    live, whole = rollups.read_rollup(spark, path), batch.rollup_minute(spark.read.parquet(files))
    assert live.select(shown).exceptAll(whole.select(shown)).count() == 0
    assert live.count() == whole.count()


def test_rollup_windows_emit_closed_minutes(spark, files):
    live = finish(spark, rollups.rollup_windows(replay(spark, files)), "windows")
    whole = batch.rollup_minute(spark.read.parquet(files))
    shown = ["minute", "span_count", "total_tokens", "p95_latency_ms"]
    assert live.select(shown).exceptAll(whole.select(shown)).count() == 0
    # The last minutes are still inside the watermark's delay.
    assert 0 < whole.count() - live.count() <= 12


def test_join_form_equals_batch(spark, files):
    kept = finish(spark, tail_sample_join(replay(spark, files), replay(spark, files)), "join")
    expected = tail_sample(spark.read.parquet(files))
    assert kept.select("span_id").exceptAll(expected.select("span_id")).count() == 0
    assert kept.count() == expected.count() > 40


def test_timed_form_decides_per_trace(spark, files):
    columns = ["trace_id", "span_id", "status_code", "start_time", "duration_ms"]
    with settings(spark, {**ONE_SHOT_SETTINGS, "spark.sql.shuffle.partitions": "2"}):
        kept = finish(spark, tail_sample_timed(replay(spark, files).select(*columns)), "timed")
    expected = tail_sample(spark.read.parquet(files))
    assert kept.select("span_id").exceptAll(expected.select("span_id")).count() == 0
    assert kept.count() == expected.count()


def test_held_spans_are_released_in_pieces():
    class Held:
        rows = [(str(i), "OK") for i in range(2 * tail_sampling.PIECE + 5)]

        def get(self):
            return iter(self.rows)

        def clear(self):
            self.rows = []

    decision = tail_sampling.TraceDecision(T.StructType([T.StructField("span_id", T.StringType()), T.StructField("status_code", T.StringType())]), 1, None)
    decision.held = Held()
    pieces = [len(p) for p in decision._release()]
    assert pieces == [tail_sampling.PIECE, tail_sampling.PIECE, 5] and decision.held.rows == []


def test_a_trace_asks_the_state_once_for_its_decision():
    """Three pieces of one trace, an error in the second: one call for the decision, one timer, the held rows first."""
    calls = []

    class State:
        rows = []

        def get(self):
            calls.append("get")
            return iter(self.rows) if self is held else None

        def exists(self):
            calls.append("exists")
            return self is held and bool(self.rows)

        def update(self, value):
            calls.append(value)

        def appendList(self, rows):
            self.rows = self.rows + rows

        def clear(self):
            self.rows = []

        def registerTimer(self, at):
            calls.append(at)

    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 100

    schema = T.StructType([T.StructField("span_id", T.StringType()), T.StructField("status_code", T.StringType()), T.StructField("duration_ms", T.DoubleType())])
    sampler, held = tail_sampling.TraceDecision(schema, 7, None), State()
    sampler.handle, sampler.decision, sampler.held = State(), State(), held
    pieces = [pd.DataFrame([(name, status, 1.0)], columns=schema.names) for name, status in (("a", "OK"), ("b", "ERROR"), ("c", "OK"))]
    out = pd.concat(sampler.handleInputRows(("t",), iter(pieces), Now()))
    assert out["span_id"].tolist() == ["a", "b", "c"] and held.rows == []
    assert calls == ["get", "exists", 107, (True,), "exists", "get"]


def test_rows_of_a_trace_are_judged_without_frames(monkeypatch):
    """An error in the second call releases what was held; a decision is remembered; no frame is built for a trace."""
    class State:
        value, rows = None, []

        def get(self):
            return iter(self.rows) if self is held else self.value

        def exists(self):
            return bool(self.rows)

        def update(self, value):
            self.value = value

        def appendList(self, rows):
            self.rows = self.rows + rows

        def clear(self):
            self.rows = []

        def registerTimer(self, at):
            self.value = at

    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 100

    schema = T.StructType([T.StructField("span_id", T.StringType()), T.StructField("status_code", T.StringType()), T.StructField("duration_ms", T.DoubleType())])
    sampler, held = tail_sampling.RowDecision(schema, 7, None), State()
    sampler.handle, sampler.decision, sampler.held = State(), State(), held
    monkeypatch.setattr(tail_sampling, "PIECE", 2)
    monkeypatch.setattr(pd, "DataFrame", None)
    row = Row(*schema.names)

    def call(*spans):
        return [r.span_id for r in sampler.handleInputRows(("t",), iter([row(*s, 1.0) for s in spans]), Now())]

    assert call(("a", "OK"), ("b", None), ("c", "OK")) == [] and sampler.handle.value == 107 and len(held.rows) == 3
    assert call(("d", "OK"), ("e", "ERROR"), ("f", "OK")) == ["a", "b", "c", "d", "e", "f"] and held.rows == []
    assert call(("g", "OK")) == ["g"]
    sampler.decision.value = (False,)
    assert call(("h", "ERROR")) == []


def test_batched_append_stores_every_row_once(spark, files):
    path, checkpoint = work_path(spark, "append"), work_path(spark, "append-checkpoint")
    for _ in range(2):
        ingest.batched_append(replay(spark, files), path, checkpoint, seconds=None).awaitTermination()
    assert spark.read.parquet(path).count() == 400


def test_partials_of_a_new_checkpoint_stay_apart(spark, files):
    path = work_path(spark, "partials")
    whole = batch.rollup_minute(spark.read.schema(SPANS).parquet(files)).agg(F.sum("span_count")).first()[0]
    for attempt in ("first", "second"):
        rollups.rollup_on_insert(replay(spark, files), path, work_path(spark, f"checkpoint-{attempt}"), seconds=None).awaitTermination()
    assert rollups.read_rollup(spark, path).agg(F.sum("span_count")).first()[0] == 2 * whole


def test_a_batch_that_is_run_again_counts_once(spark, files):
    path, checkpoint = work_path(spark, "partials"), work_path(spark, "checkpoint")
    rollups.rollup_on_insert(replay(spark, files), path, checkpoint, seconds=None).awaitTermination()
    before = sorted(map(str, rollups.read_rollup(spark, path).select("minute", "span_count").collect()))
    run = rollups.run_id(spark, checkpoint)
    assert run == rollups.run_id(spark, checkpoint)
    again = spark.read.parquet(f"{path}/run={run}/batch=0").withColumn("on_day", F.lit("2024-01-01"))
    again = spark.createDataFrame(again.collect(), again.schema)
    again.write.mode("overwrite").partitionBy("on_day").parquet(f"{path}/run={run}/batch=0")
    assert sorted(map(str, rollups.read_rollup(spark, path).select("minute", "span_count").collect())) == before


def test_since_prunes_days(spark, files):
    path = work_path(spark, "partials")
    rollups.rollup_on_insert(replay(spark, files), path, work_path(spark, "checkpoint"), seconds=None).awaitTermination()
    plan = rollups.read_partials(spark, path, "2024-02-01 00:00:00")
    assert plan.count() == 0
    assert "PartitionFilters: [isnotnull(on_day" in plan._jdf.queryExecution().toString()


def test_files_of_a_stream_are_read_by_many_tasks(spark, tmp_path):
    """Each file is a batch of its own, and must not be one row group, which one task would read."""
    rows = spark.range(1_500_000).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    rows.write.parquet(f"{tmp_path}/wide.parquet")
    streams.stream_in_order(spark, str(tmp_path), "wide", "id")
    written = max(Path(spark.conf.get("spark.checkpoint.dir")).glob("wide-files-*"), key=lambda p: p.stat().st_mtime)
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in written.glob("*.parquet")]
    assert len(groups) == streams.FILES + streams.LATE_FILES and max(groups) > 2
    assert spark.read.parquet(str(written)).count() == 1_500_000
