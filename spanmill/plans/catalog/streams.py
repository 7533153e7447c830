"""Streaming pipelines, replayed over the given tables until all input is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import alerts, evals, scoring, summaries
from spanmill.operators.cost import price_spans
from spanmill.operators.tail_sampling import SLOW_MS, tail_sample
from spanmill.plans import derived, incremental
from spanmill.plans.catalog.alerting import ERROR_CTES, ERROR_SIGNAL, HOUR, HOURLY_RULES, INTERVALS, SIX_HOURS, interval_ctes
from spanmill.plans.catalog.privacy import PII, QUEUE
from spanmill.plans.catalog.joins import TREE
from spanmill.plans.catalog.registry import query
from spanmill.plans.catalog.rollup import COLUMNS, DAILY, rollup_sql
from spanmill.plans.catalog.score import FAITHFUL, SETS, TOXIC
from spanmill.plans.catalog.sql import EVALS, PRICED, PRICING, RAW_EVALS, RESPONSES, SPANS, on_priced, on_spans, with_
from spanmill.schemas import PII_QUEUE
from spanmill.session import settings, work_path
from spanmill.sources.facts import read_table
from spanmill.sources.pricing import seed_pricing
from spanmill.streaming import alerts as live_alerts
from spanmill.streaming import dedup, ingest, pii, rollups
from spanmill.streaming import summaries as live_summaries
from spanmill.streaming.tail_sampling import ONE_SHOT_SETTINGS, tail_sample_join, tail_sample_timed

KEPT = "substr(md5(trace_id), 1, 8) < '1999999a'"
SPAN_COLUMNS = ["trace_id", "span_id", "status_code", "start_time", "duration_ms"]


#: Files that a streamed table is dealt into besides the late ones, one batch each.
FILES, LATE_FILES = 4, 2
#: Bytes of a row group of such a file: a batch is one file, and a row group is the least that a task reads.
ROW_GROUP = 4 << 20


def stream(spark, sf, name: str):
    """A given table as a stream of files."""
    schema = derived.table(spark, sf, name).schema
    return ingest.stream_files(spark, f"{sf}/{name}*.parquet", schema)


def stream_in_order(spark, sf, name: str, order: str):
    """A given table as a stream of ``FILES`` files in the order of a column, and behind them files of rows that come late."""
    rows = derived.table(spark, sf, name)
    path = work_path(spark, f"{name}-files")
    late = F.pmod(F.xxhash64(order), F.lit(10)) == 0
    rows.filter(~late).repartitionByRange(FILES, order).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    rows.filter(late).repartition(LATE_FILES, order).write.option("parquet.block.size", ROW_GROUP).mode("append").parquet(path)
    return ingest.stream_files(spark, path, rows.schema, max_files=1)


def stream_spans(spark, sf):
    return derived.spans_of(stream(spark, sf, "events"))


def stream_spans_in_order(spark, sf):
    return derived.spans_of(stream_in_order(spark, sf, "events", "ts"))


def append_to(spark, frame, name: str):
    """Run a stream to the end of its input and read what it appended."""
    path, checkpoint = work_path(spark, name), work_path(spark, f"{name}-checkpoint")
    schema = frame.schema
    writer = frame.writeStream.format("parquet").outputMode("append").option("path", path)
    ingest.start(writer, checkpoint, seconds=None).awaitTermination()
    return spark.read.schema(schema).parquet(path)


@query("tail_sample", on_spans(
    "SELECT trace_id, span_id, status_code, start_time, duration_ms FROM spans WHERE trace_id IN "
    f"(SELECT trace_id FROM spans WHERE status_code = 'ERROR') OR {KEPT}"))
def sample_batch(spark, sf):
    return tail_sample(derived.spans(spark, sf)).select(*SPAN_COLUMNS)


@query("latency_policy", on_spans(
    "SELECT trace_id, span_id, status_code, start_time, duration_ms FROM spans WHERE trace_id IN "
    f"(SELECT trace_id FROM spans WHERE status_code = 'ERROR' OR duration_ms > 5000) OR {KEPT}"))
def latency_policy(spark, sf):
    return tail_sample(derived.spans(spark, sf), slow_ms=SLOW_MS).select(*SPAN_COLUMNS)


@query("tail_sample_stream", on_spans(
    "SELECT trace_id, span_id, status_code, start_time, duration_ms FROM spans WHERE trace_id IN "
    f"(SELECT trace_id FROM spans WHERE status_code = 'ERROR') OR {KEPT}"))
def sample_stream(spark, sf):
    # Spans of a trace lie hours apart in the given tables.
    kept = tail_sample_join(stream_spans(spark, sf), stream_spans(spark, sf), trace_length="10 days")
    return append_to(spark, kept, "tail-sample").select(*SPAN_COLUMNS)


@query("tail_sample_timed", on_spans(
    "SELECT trace_id, span_id, status_code, start_time, duration_ms FROM spans WHERE trace_id IN "
    f"(SELECT trace_id FROM spans WHERE status_code = 'ERROR') OR {KEPT}"))
def sample_timed(spark, sf):
    with settings(spark, ONE_SHOT_SETTINGS):
        return append_to(spark, tail_sample_timed(stream_spans(spark, sf).select(*SPAN_COLUMNS)), "tail-timed")


@query("rollup_stream", on_priced(rollup_sql("minute")), digits=9)
def rollup_stream(spark, sf):
    path, checkpoint = work_path(spark, "rollup"), work_path(spark, "rollup-checkpoint")
    priced = price_spans(stream_spans_in_order(spark, sf), seed_pricing(spark))
    rollups.rollup_on_insert(priced, path, checkpoint, seconds=None).awaitTermination()
    rollups.merge_stored_rollup(spark, path)
    return rollups.read_rollup(spark, path).select("minute", *COLUMNS)


@query("eval_rollup_stream", with_(DAILY.format("raw_evals"), RAW_EVALS))
def eval_rollup_stream(spark, sf):
    path, checkpoint = work_path(spark, "evals"), work_path(spark, "evals-checkpoint")
    live = derived.evals_of(stream_in_order(spark, sf, "labels", "doc_id"))
    rollups.eval_rollup_on_insert(live, path, checkpoint, seconds=None).awaitTermination()
    rollups.merge_stored_eval_rollup(spark, path)
    return rollups.read_eval_rollup(spark, path)


@query("alert_stream", with_(INTERVALS, SPANS, *ERROR_CTES, *interval_ctes(ERROR_SIGNAL, HOURLY_RULES[:1])))
def alert_stream(spark, sf):
    path, checkpoint = work_path(spark, "ticks"), work_path(spark, "ticks-checkpoint")
    live_alerts.alert_ticks(stream_spans_in_order(spark, sf), path, checkpoint, HOUR, ["app_id"], seconds=None).awaitTermination()
    live_alerts.merge_stored_ticks(spark, path, ["app_id"])
    rules = alerts.rule_table(spark, HOURLY_RULES[:1])
    return live_alerts.evaluate_ticks(spark, path, rules, derived.AS_OF, HOUR, SIX_HOURS, ["app_id"])


@query("pii_stream", with_("SELECT trace_id, score, detected_items, response_text, evaluated_at, false AS resolved FROM queue", *PII, QUEUE))
def pii_stream(spark, sf):
    path, checkpoint = work_path(spark, "queue"), work_path(spark, "queue-checkpoint")
    live = derived.answers_of(stream(spark, sf, "conversations"))
    pii.pii_stream(live, path, checkpoint, derived.AS_OF, seconds=None).awaitTermination()
    return read_table(spark, path, PII_QUEUE).drop("inserted_at")


@query("batched_append", on_spans("SELECT provider, strftime(start_time, '%Y%m') AS month, count(*) AS span_count FROM spans GROUP BY 1, 2"))
def batched_append(spark, sf):
    path, checkpoint = work_path(spark, "spans"), work_path(spark, "spans-checkpoint")
    ingest.batched_append(stream_spans(spark, sf), path, checkpoint, seconds=None).awaitTermination()
    stored = spark.read.parquet(path)
    return stored.groupBy("provider", F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("span_count"))


def stream_with_repeats(spark, sf):
    """The events in files by time; a third of each file's rows come again in the next file, a tenth of all late, some of those twice."""
    events = derived.table(spark, sf, "events")
    path = work_path(spark, "repeated-events")
    late = F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0
    again = F.pmod(F.xxhash64("event_id", F.lit("again")), F.lit(3)) == 0
    first, last = events.select(F.min("ts").cast("timestamp").cast("double"), F.max("ts").cast("timestamp").cast("double")).first()
    share = (F.col("ts").cast("timestamp").cast("double") - F.lit(first)) / F.lit(max(last - first, 1.0))
    on_time = events.filter(~late).withColumn("file", F.least(F.floor(share * FILES).cast("int") + 1, F.lit(FILES)))
    repeats = on_time.filter(again).withColumn("file", F.least(F.col("file") + 1, F.lit(FILES)))
    dealt = on_time.unionByName(repeats).unionByName(events.filter(late).withColumn("file", F.lit(FILES + 1)))
    dealt = dealt.unionByName(events.filter(late & again).withColumn("file", F.lit(FILES + 2)))
    for number in range(1, FILES + 3):
        dealt.filter(F.col("file") == number).drop("file").write.mode("append").parquet(path)
    return derived.spans_of(ingest.stream_files(spark, path, events.schema))


SPAN_KEYS = "trace_id, span_id, parent_span_id, provider, start_time, duration_ms"


@query("dedup_stream", on_spans(f"SELECT DISTINCT {SPAN_KEYS} FROM spans"))
def dedup_stream(spark, sf):
    """Repeats across files and late files, equal to the batch distinct."""
    path, checkpoint = work_path(spark, "once"), work_path(spark, "once-checkpoint")
    live = stream_with_repeats(spark, sf)
    dedup.dedup_on_insert(live, path, checkpoint, seconds=None).awaitTermination()
    return dedup.read_deduped(spark, path, live.schema).select(*SPAN_KEYS.split(", "))


@query("dedup_window", on_spans(f"SELECT DISTINCT {SPAN_KEYS} FROM spans"))
def dedup_window(spark, sf):
    """The form with state, its watermark beyond the span of the table."""
    live = dedup.dedup_within(stream_with_repeats(spark, sf), delay="400 days")
    return append_to(spark, live, "once-in-window").select(*SPAN_KEYS.split(", "))


@query("unevaluated_spans", with_(
    "SELECT trace_id, span_id, metric_name FROM spans CROSS JOIN (VALUES ('faithfulness'), ('toxicity'), ('toxicity_insult')) AS m(metric_name) "
    "WHERE NOT EXISTS (SELECT 1 FROM evals e WHERE e.trace_id = spans.trace_id AND e.span_id = spans.span_id AND e.metric_name = m.metric_name)", SPANS, EVALS))
def unevaluated_spans(spark, sf):
    lacking = evals.unevaluated_spans(derived.spans(spark, sf), derived.evals(spark, sf), ["faithfulness", "toxicity", "toxicity_insult"])
    return lacking.select("trace_id", "span_id", "metric_name")


@query("micro_batch_jobs", with_(
    f"SELECT trace_id, span_id, m AS metric_name, round(s, 12) AS score FROM (SELECT trace_id, span_id, unnest(['toxicity', 'faithfulness']) AS m, "
    f"unnest([{TOXIC}, {FAITHFUL}]) AS s FROM (SELECT trace_id, span_id, rt, {{0}} AS rw, {{0}} AS cw FROM sets)) WHERE s IS NOT NULL".replace("{0}", "rw"), RESPONSES, SETS), digits=12)
def micro_batch_jobs(spark, sf):
    """Batches of a stream, a batch run again, and two windows that overlap them and each other: every span once."""
    path, checkpoint = work_path(spark, "scored"), work_path(spark, "scored-checkpoint")
    scorers = {"toxicity": scoring.toxicity(), "faithfulness": scoring.faithfulness("response", "response")}
    turns = derived.table(spark, sf, "conversations")
    files, late = work_path(spark, "turns"), F.pmod(F.xxhash64("conv_id"), F.lit(4)) == 0
    turns.filter(~late).repartitionByRange(FILES, "conv_id", "turn").write.parquet(files)
    live = derived.answers_of(ingest.stream_files(spark, files, turns.schema, max_files=1))
    incremental.micro_batch_jobs(live, path, checkpoint, scorers, derived.AS_OF, seconds=None).awaitTermination()
    answers = derived.answers_only(spark, sf)
    slot = f"{rollups.run_id(spark, checkpoint)}-0"
    incremental.score_new(answers.filter(F.pmod(F.xxhash64("conv_id"), F.lit(4)) == 1), path, slot, derived.AS_OF, scorers)
    for days in (20, 60, 60):
        incremental.score_window(answers, path, derived.AS_OF, scorers, days=days)
    return incremental.read_scores(spark, path).select("trace_id", "span_id", "metric_name", "score")


SUMMARY = (
    "SELECT trace_id, any_value(r.span_name) AS root_name, any_value(r.service_name) AS service_name, any_value(r.provider) AS provider, any_value(r.model) AS model, "
    "CASE WHEN count(*) FILTER (s.status_code = 'ERROR') > 0 THEN 'ERROR' ELSE 'OK' END AS status_code, count(*) AS span_count, "
    "count(*) FILTER (s.status_code = 'ERROR') AS error_count, CAST(sum(s.input_tokens) AS BIGINT) AS input_tokens, CAST(sum(s.output_tokens) AS BIGINT) AS output_tokens, "
    "CAST(sum(s.input_tokens + s.output_tokens) AS BIGINT) AS total_tokens, round(CAST(sum(CAST(s.cost_usd AS DECIMAL(28, 12))) AS DOUBLE), 9) AS total_cost, count(*) FILTER (s.cost_usd IS NULL) AS unpriced_spans, "
    "min(s.start_time) AS first_start, max(s.start_time + to_microseconds(CAST(round(s.duration_ms * 1000) AS BIGINT))) AS last_end, "
    "round(epoch_us(max(s.start_time + to_microseconds(CAST(round(s.duration_ms * 1000) AS BIGINT)))) / 1000.0 - epoch_us(min(s.start_time)) / 1000.0, 3) AS duration_ms, max(t.depth) AS max_depth "
    "FROM priced s JOIN tree t USING (trace_id, span_id) LEFT JOIN (SELECT * FROM spans WHERE parent_span_id = '') r USING (trace_id) GROUP BY trace_id"
)
SUMMARY_CTES = [SPANS, PRICING, PRICED, TREE]


@query("trace_summary", with_(SUMMARY, *SUMMARY_CTES, recursive=True), digits=9)
def trace_summary(spark, sf):
    return summaries.trace_summary(derived.priced_spans(spark, sf)).withColumn("duration_ms", F.round("duration_ms", 3))


@query("trace_summary_stream", with_(SUMMARY, *SUMMARY_CTES, recursive=True), digits=9)
def trace_summary_stream(spark, sf):
    """The same from batches: traces are spread over several, and some spans come late."""
    path, checkpoint = work_path(spark, "summaries"), work_path(spark, "summaries-checkpoint")
    priced = price_spans(stream_spans_in_order(spark, sf), seed_pricing(spark))
    live_summaries.summarise_on_insert(priced, path, checkpoint, seconds=None).awaitTermination()
    return live_summaries.read_summaries(spark, path).withColumn("duration_ms", F.round("duration_ms", 3))
