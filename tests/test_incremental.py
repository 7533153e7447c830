"""State that is carried from batch to batch: deduplication, scoring once, trace summaries."""

import pytest
from pyspark.sql import functions as F

from spanmill.operators import evals, summaries
from spanmill.plans import incremental
from spanmill.session import work_path
from spanmill.sources import slots
from spanmill.streaming import dedup, ingest
from spanmill.streaming import summaries as live

COLUMNS = "trace_id string, span_id string, parent_span_id string, span_name string, service_name string, provider string, model string, status_code string, input_tokens bigint, output_tokens bigint, cost_usd double, start_time timestamp, duration_ms double, response string"


def span(trace, number, parent="", start="2024-01-05 10:00:00", cost=0.5, status="OK", duration=100.0, response="fine words"):
    return (trace, f"{trace}-{number}", f"{trace}-{parent}" if parent != "" else "", f"n{number}", "svc", "p", "m", status, 3, 4, cost, start, duration, response)


def frame(spark, rows):
    kinds = COLUMNS.replace("timestamp", "string")
    return spark.createDataFrame(rows, kinds).withColumn("start_time", F.col("start_time").cast("timestamp"))


def replay(spark, *files):
    path = work_path(spark, "replay")
    for rows in files:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(path)
    return ingest.stream_files(spark, path, frame(spark, []).schema, max_files=1)


def ids(df):
    return sorted(r["span_id"] for r in df.select("span_id").collect())


FIRST = [span("a", 1), span("a", 2, 1), span("a", 1)]
SECOND = [span("a", 2, 1), span("b", 1, start="2024-02-03 00:00:00")]
LATE = [span("c", 1, start="2023-11-01 00:00:00"), span("a", 1), span("c", 1, start="2023-11-01 00:00:00")]


def test_each_span_is_stored_once(spark):
    path, checkpoint = work_path(spark, "once"), work_path(spark, "checkpoint")
    stream = replay(spark, FIRST, SECOND, LATE)
    for _ in range(2):
        dedup.dedup_on_insert(stream, path, checkpoint, seconds=None).awaitTermination()
    stored = dedup.read_deduped(spark, path, stream.schema)
    assert ids(stored) == ["a-1", "a-2", "b-1", "c-1"]
    assert set(stored.columns) == set(stream.columns)


def test_a_batch_that_runs_again_replaces_its_slot(spark):
    path = work_path(spark, "once")
    for slot, rows in (("r-0", FIRST), ("r-1", SECOND), ("r-1", SECOND), ("r-0", FIRST)):
        dedup.insert_new(frame(spark, rows), path, slot)
    assert ids(dedup.read_deduped(spark, path, frame(spark, []).schema)) == ["a-1", "a-2", "b-1"]


def test_spans_without_a_time_stay(spark):
    path = work_path(spark, "once")
    dedup.insert_new(frame(spark, [span("a", 1, start=None), span("a", 2)]), path, "r-0")
    assert ids(dedup.read_deduped(spark, path, frame(spark, []).schema)) == ["a-1", "a-2"]


def test_lookups_read_the_months_of_the_batch(spark):
    path = work_path(spark, "once")
    for slot, rows in (("r-0", FIRST), ("r-1", SECOND)):
        dedup.insert_new(frame(spark, rows), path, slot)
    plan = slots.read_slots(spark, path, frame(spark, []).schema, ["202402"], without="r-2").select("trace_id")
    assert [r["trace_id"] for r in plan.collect()] == ["b"]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "month" in text.split("PartitionFilters")[1] and "response" not in text.split("ReadSchema")[1]


def test_state_drops_what_the_watermark_has_seen(spark):
    later = [span("z", 1, start="2024-01-05 12:00:00")]
    path, checkpoint = work_path(spark, "window"), work_path(spark, "checkpoint")
    live_rows = dedup.dedup_within(replay(spark, FIRST, SECOND[:1], later, LATE), delay="30 minutes")
    writer = live_rows.writeStream.format("parquet").outputMode("append").option("path", path)
    ingest.start(writer, checkpoint, seconds=None).awaitTermination()
    assert ids(spark.read.schema(live_rows.schema).parquet(path)) == ["a-1", "a-2", "z-1"]


def scorers(*names):
    made = {"length": F.length("response").cast("double"), "none": F.lit(None).cast("double")}
    return {name: made[name] for name in names or made}


def test_overlapping_windows_score_a_span_once(spark):
    path = work_path(spark, "scores")
    rows = frame(spark, [span("a", 1, start="2024-01-05 10:00:00"), span("b", 1, start="2024-01-05 10:10:00"), span("b", 1, start="2024-01-05 10:10:00"), span("c", 1, start="2024-01-05 10:20:00")])
    for as_of in ("2024-01-05 10:14:00", "2024-01-05 10:24:00", "2024-01-05 10:24:00", "2024-01-05 10:14:00"):
        incremental.score_window(rows, path, as_of, scorers())
    scores = incremental.read_scores(spark, path)
    assert sorted((r["span_id"], r["metric_name"], r["score"]) for r in scores.collect()) == [(f"{k}-1", "length", 10.0) for k in "abc"]
    assert slots.read_slots(spark, path, incremental.SCORES).count() == 6
    assert incremental.read_scores(spark, path, since="2024-01-05 10:15:00").count() == 1


def test_failed_metrics_are_tried_again_on_demand_only(spark):
    path = work_path(spark, "scores")
    rows = frame(spark, [span("a", 1)])
    incremental.score_window(rows, path, "2024-01-05 10:05:00", scorers("none"))
    incremental.score_window(rows, path, "2024-01-05 10:06:00", scorers())
    assert incremental.read_scores(spark, path).count() == 0
    incremental.score_window(rows, path, "2024-01-05 10:07:00", scorers(), retry=True)
    assert incremental.read_scores(spark, path).count() == 1


def test_micro_batches_score_once_and_after_a_window(spark):
    path, checkpoint = work_path(spark, "scores"), work_path(spark, "checkpoint")
    seen = []
    stream = replay(spark, FIRST, SECOND, LATE)
    incremental.score_window(frame(spark, FIRST), path, "2024-01-05 10:10:00", scorers())
    for _ in range(2):
        incremental.micro_batch_jobs(stream, path, checkpoint, scorers(), "2024-03-01 00:00:00", seconds=None, then=lambda batch, n: seen.append(n)).awaitTermination()
    assert ids(incremental.read_scores(spark, path)) == ["a-1", "a-2", "b-1", "c-1"]
    assert seen == [0, 1, 2]


def test_unevaluated_spans(spark):
    rows = frame(spark, [span("a", 1), span("a", 2, 1), span("b", 1)])
    done = spark.createDataFrame([("a", "a-1", "x")] * 3 + [("b", "b-1", "y")], "trace_id string, span_id string, metric_name string")
    assert ids(evals.unevaluated_spans(rows, done)) == ["a-2"]
    lacking = evals.unevaluated_spans(rows, done, ["x", "y"]).collect()
    assert sorted((r["span_id"], r["metric_name"]) for r in lacking) == [("a-1", "y"), ("a-2", "x"), ("a-2", "y"), ("b-1", "x")]
    assert evals.unevaluated_spans(rows, done.limit(0)).count() == 3


TREE = [span("t", 1), span("t", 2, 1, start="2024-01-05 10:00:01", status="ERROR"), span("t", 3, 2, start="2024-01-06 10:00:02", cost=None, duration=None), span("u", 9, 8)]


def test_trace_summary(spark):
    found = {r["trace_id"]: r for r in summaries.trace_summary(frame(spark, TREE)).collect()}
    one = found["t"]
    assert (one["span_count"], one["error_count"], one["status_code"], one["total_tokens"], one["total_cost"], one["unpriced_spans"], one["max_depth"], one["root_name"]) == (3, 1, "ERROR", 21, 1.0, 1, 2, "n1")
    assert one["duration_ms"] == 86_402_000.0
    # A trace whose root is lost.
    assert (found["u"]["root_name"], found["u"]["max_depth"], found["u"]["status_code"]) == (None, 0, "OK")
    assert summaries.trace_summary(frame(spark, [])).count() == 0


@pytest.mark.parametrize("files", [(TREE,), (TREE[2:], TREE[:1], TREE[1:2]), tuple([row] for row in reversed(TREE))])
def test_batches_add_up_to_the_whole(spark, files):
    path, checkpoint = work_path(spark, "summaries"), work_path(spark, "checkpoint")
    live.summarise_on_insert(replay(spark, *files), path, checkpoint, seconds=None).awaitTermination()
    whole = sorted(map(tuple, summaries.trace_summary(frame(spark, TREE)).collect()), key=str)
    assert sorted(map(tuple, live.read_summaries(spark, path).collect()), key=str) == whole
    recent = live.read_summaries(spark, path, since="2024-01-06 00:00:00").collect()
    assert [(r["trace_id"], r["span_count"]) for r in recent] == [("t", 1)]


def test_a_trace_of_most_spans_is_not_gathered(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 20 > 0, "hot").otherwise(F.col("id").cast("string")).alias("trace_id"), F.col("id").cast("string").alias("span_id"),
        F.when(F.col("id") > 20, "1").otherwise("").alias("parent_span_id"), F.lit("n").alias("span_name"), F.lit("s").alias("service_name"), F.lit("p").alias("provider"),
        F.lit("m").alias("model"), F.lit("OK").alias("status_code"), F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(0.25).alias("cost_usd"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("start_time"), F.lit(1.0).alias("duration_ms"),
    )
    part = summaries.partial_summary(rows)
    hot = part.filter("trace_id = 'hot'").first()
    assert hot["span_count"] == 57_000 and float(hot["total_cost"]) == 14_250.0
    text = part._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and text.count("HashAggregate") + text.count("SortAggregate") == 2
