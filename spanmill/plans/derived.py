"""Span-shaped tables out of the given event, label, conversation and embedding tables.

The given tables hold no spans, so every catalogue query reads these. Expressions in
``SPAN_EXPRS`` and ``RESPONSE_EXPRS`` are text that Spark and the checking engine both
run, which makes both see the same rows. Frames are kept per session: they are only plans,
and reading a table's schema again for each use would cost a job.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions import times
from spanmill.functions.text import sentences
from spanmill.operators.cost import price_spans
from spanmill.session import work_path
from spanmill.sources.current import read_current, upsert_current
from spanmill.sources.pricing import seed_pricing

AS_OF = "2024-01-31 00:00:00"

SPAN_EXPRS = [
    "md5(concat('t', cast(floor(event_id / 4) as bigint))) AS trace_id",
    "substr(md5(concat('s', event_id)), 1, 16) AS span_id",
    "CASE WHEN event_id % 4 = 0 THEN '' "
    "WHEN event_id % 4 = 3 THEN substr(md5(concat('s', event_id - 2)), 1, 16) "
    "ELSE substr(md5(concat('s', event_id - 1)), 1, 16) END AS parent_span_id",
    "concat(CASE event_id % 6 WHEN 3 THEN 'langchain' WHEN 4 THEN 'llamaindex' ELSE 'chat' END, '-svc') AS service_name",
    "event_type AS span_name",
    "CASE WHEN event_id % 4 = 0 THEN 'INTERNAL' ELSE 'CLIENT' END AS span_kind",
    "CASE WHEN event_type = 'error' AND value > 30 THEN 'ERROR' ELSE 'OK' END AS status_code",
    "CASE event_id % 6 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'gcp.gen_ai' "
    "WHEN 3 THEN 'langchain' WHEN 4 THEN 'llamaindex' ELSE 'vllm' END AS provider",
    "CASE event_id % 6 WHEN 0 THEN (CASE WHEN user_id % 2 = 0 THEN 'gpt-4o' ELSE 'gpt-4o-mini' END) "
    "WHEN 1 THEN 'claude-3.5-sonnet-20241022' WHEN 2 THEN 'gemini-2.0-flash' "
    "WHEN 5 THEN 'meta-llama/Llama-3.1-8B-Instruct' ELSE 'gpt-4o' END AS model",
    "'chat' AS operation_name",
    "cast(regexp_extract(props, '([0-9]+)', 1) as bigint) + 1 AS input_tokens",
    "cast(floor(value * 10) as bigint) + 1 AS output_tokens",
    "concat('resp-', event_id) AS response_id",
    "concat('user-', user_id) AS user_id",
    "concat('app-', user_id % 5) AS app_id",
    "concat('conv-', cast(floor(event_id / 4) as bigint)) AS conversation_id",
    "cast(ts as timestamp) AS start_time",
    "round(value * 25, 2) AS duration_ms",
    "event_id",
]

# Appended to a tenth of the responses, so that the scan has something to find.
LEAK = " For the form: number 219-09-9999, and write to kim.lee@mail.example.org"
LEAK_BOUND = "1999999a"

RESPONSE_EXPRS = [
    "md5(concat('c', conv_id)) AS trace_id",
    "substr(md5(concat('c', conv_id, '-', turn)), 1, 16) AS span_id",
    "'' AS parent_span_id",
    "CASE conv_id % 3 WHEN 0 THEN 'chat-svc' WHEN 1 THEN 'langchain-svc' ELSE 'llamaindex-svc' END AS service_name",
    "'CLIENT' AS span_kind",
    "CASE conv_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'gcp.gen_ai' END AS provider",
    "CASE conv_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3.5-sonnet' ELSE 'gemini-2.0-flash' END AS model",
    f"TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * (conv_id % 35) - INTERVAL 1 MINUTE * (turn + 1) AS start_time",
    "conv_id",
    "turn",
]
LEAKED = (
    f"CASE WHEN substr(md5(concat('pii', conv_id, '-', turn)), 1, 8) < '{LEAK_BOUND}' "
    f"THEN concat(text, '{LEAK}') ELSE text END"
)

EVAL_KEYS = ["trace_id", "metric_name"]
EVAL_METRICS = ["faithfulness", "toxicity", "answer_relevancy"]


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_of(events: DataFrame) -> DataFrame:
    """Works on a stream of events too."""
    return events.selectExpr(*SPAN_EXPRS)


@lru_cache(maxsize=64)
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "events"))


# View spans report under a wrong trace id, so their children name a parent that their own trace does not hold.
TORN_TRACE = "CASE WHEN span_name = 'view' THEN md5(concat('torn', span_id)) ELSE trace_id END"


@lru_cache(maxsize=64)
def torn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).withColumn("trace_id", F.expr(TORN_TRACE))


@lru_cache(maxsize=64)
def priced_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_spans(spans(spark, sf_dir), seed_pricing(spark))


def evals_of(labels: DataFrame) -> DataFrame:
    """Three metrics per label, every fifth document scored a second time, and one
    ``toxicity_<category>`` row each."""
    score = (
        "CASE WHEN m = 'toxicity' THEN cast(toxic as double) "
        "ELSE round(0.4 + 0.5 * quality + (doc_id % 10) / 100.0 - 0.2 * v * (doc_id % 2), 4) END"
    )
    versions = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    main = (
        labels.withColumn("m", F.explode(F.array(*[F.lit(m) for m in EVAL_METRICS])))
        .withColumn("v", F.explode(versions))
        .selectExpr("doc_id", "m AS metric_name", f"cast({score} as double) AS score", "v AS ver")
    )
    category = "CASE doc_id % 3 WHEN 0 THEN 'insult' WHEN 1 THEN 'threat' ELSE 'profanity' END"
    by_category = labels.selectExpr(
        "doc_id", f"concat('toxicity_', {category}) AS metric_name",
        "cast(toxic * 0.5 + (doc_id % 10) / 100.0 as double) AS score", "0 AS ver",
    )
    return main.unionByName(by_category).selectExpr(
        "md5(concat('t', doc_id)) AS trace_id",
        "substr(md5(concat('s', doc_id * 4)), 1, 16) AS span_id",
        "metric_name", "score",
        "CASE doc_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3.5-sonnet' ELSE 'gemini-2.0-flash' END AS evaluated_model",
        f"TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * (doc_id % 40) - INTERVAL 1 MINUTE AS evaluated_at",
        f"TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * (doc_id % 40) + INTERVAL 1 MINUTE * ver AS inserted_at",
        "doc_id",
    )


@lru_cache(maxsize=64)
def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals_of(table(spark, sf_dir, "labels"))


@lru_cache(maxsize=64)
def stored_evals(spark: SparkSession, sf_dir: str) -> str:
    """Path of the current-eval table, written once a session from two batches in which versions come out of order."""
    path, rows = work_path(spark, "current-evals"), evals(spark, sf_dir)
    first = F.pmod(F.xxhash64("trace_id", "metric_name", "inserted_at"), F.lit(2)) == 0
    for batch in (rows.filter(first), rows.filter(~first)):
        upsert_current(batch, path, EVAL_KEYS, "inserted_at", "evaluated_at", "span_id")
    return path


def current_evals(spark: SparkSession, sf_dir: str, days: int | None = None) -> DataFrame:
    """The latest insert per (trace, metric), from the stored table; with ``days`` only the months of that many days are read."""
    schema = evals(spark, sf_dir).schema
    path = stored_evals(spark, sf_dir)
    if days is None:
        return read_current(spark, path, schema)
    return read_current(spark, path, schema, times.moment(AS_OF) - times.interval(days=days), AS_OF)


@lru_cache(maxsize=64)
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with the turn before as question; context is the question and the
    document of the same number, and its sentences are the passages."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("document"))
    answers = turns.filter(F.col("role") == "assistant").selectExpr(*RESPONSE_EXPRS, f"{LEAKED} AS response")
    return (
        answers.join(asked, ["conv_id", "turn"], "left")
        .join(documents, "conv_id", "left")
        .withColumn("question", F.coalesce("question", F.lit("")))
        .withColumn("context", F.concat("question", F.lit("\n"), F.coalesce("document", F.lit(""))))
        .drop("document")
        .withColumn("passages", sentences("context"))
    )


@lru_cache(maxsize=64)
def answers_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses without question and context, for scans of the response alone."""
    return answers_of(table(spark, sf_dir, "conversations"))


def answers_of(turns: DataFrame) -> DataFrame:
    return turns.filter(F.col("role") == "assistant").selectExpr(*RESPONSE_EXPRS, f"{LEAKED} AS response")


@lru_cache(maxsize=64)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as prompts with their time."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return turns.selectExpr(*RESPONSE_EXPRS, "text AS prompt")


@lru_cache(maxsize=64)
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings: labels 0 to 4 are the baseline, 5 to 9 the current side."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "embedding", "CASE WHEN label < 5 THEN 'baseline' ELSE 'current' END AS side",
        "date_add(DATE '2024-01-26', label % 5) AS score_date",
    )
