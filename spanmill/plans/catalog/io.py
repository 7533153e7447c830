"""Sources and sinks. Each query writes to the shared folder and reads back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from spanmill.functions.genai import ATTRIBUTE_COLUMNS, canonical_model
from spanmill.operators import evals, pii, search
from spanmill.operators.exposition import exposition
from spanmill.operators.normalize import with_defaults
from spanmill.plans import derived, jobs
from spanmill.plans.catalog.drifting import DRIFT_TABLE_SQL, drift_table
from spanmill.plans.catalog.privacy import PII, QUEUE
from spanmill.plans.catalog.registry import query
from spanmill.plans.catalog.sql import CANONICAL, END, EVAL_IN_MONTH, EVALS, PRICING, SPANS, on_spans, with_
from spanmill.schemas import DRIFT_SCORES, EVALS as EVAL_SCHEMA, PII_QUEUE, SPANS as SPAN_SCHEMA
from spanmill.session import work_path
from spanmill.sources import json_rows, otlp, pricing, spans as span_table
from spanmill.sources.facts import append_table, read_table
from spanmill.sources.retention import apply_retention

AS_OF = derived.AS_OF
SHOWN = ["trace_id", "span_id", "parent_span_id", "provider", "model", "status_code", "input_tokens", "output_tokens", "start_time", "duration_ms"]
SHOWN_SQL = ", ".join(SHOWN)


def stored_spans(spark, sf, **options) -> str:
    path = work_path(spark, "spans")
    span_table.write_spans(with_defaults(derived.spans(spark, sf), AS_OF), path, **options)
    return path


@query("read_spans", on_spans(
    f"SELECT {SHOWN_SQL} FROM spans WHERE start_time >= TIMESTAMP '2024-01-10 00:00:00' AND start_time < TIMESTAMP '2024-01-25 00:00:00'"))
def read_spans(spark, sf):
    return span_table.read_spans(spark, stored_spans(spark, sf), SHOWN, "2024-01-10 00:00:00", "2024-01-25 00:00:00")


@query("read_json_rows", on_spans(f"SELECT {SHOWN_SQL} FROM spans"))
def read_json_rows(spark, sf):
    path = work_path(spark, "json")
    json_rows.write_json_rows(with_defaults(derived.spans(spark, sf), AS_OF), path)
    return json_rows.read_json_rows(spark, path, SPAN_SCHEMA).select(*SHOWN)


def _attribute(name: str, value):
    typed = F.struct(value.cast("string").alias("stringValue"))
    return F.struct(F.lit(name).alias("key"), typed.alias("value"))


def _kinds_of_values() -> list:
    """A list, a map around a list and bytes, with values of the span in them."""
    text, number = F.struct(F.col("model").alias("stringValue")), F.struct(F.col("input_tokens").cast("string").alias("intValue"))
    either = F.array(
        F.struct(F.col("status_code").alias("stringValue"), F.lit(None).cast("boolean").alias("boolValue")),
        F.struct(F.lit(None).cast("string").alias("stringValue"), (F.col("input_tokens") > 500).alias("boolValue")),
    )
    inner = F.struct(F.struct(either.alias("values")).alias("arrayValue"))
    entries = {"model": F.to_json(text), "tokens": F.to_json(number), 'said "{}"': F.to_json(inner)}
    held = F.concat_ws(",", *[F.concat(F.lit(f'{{"key": {json.dumps(name)}, "value": '), value, F.lit("}")) for name, value in entries.items()])
    return [
        F.concat(F.lit('{"key":"finish_reasons","value":'), F.to_json(inner), F.lit("}")),
        F.concat(F.lit('{"key":"limits","value":{"kvlistValue":{"values":['), held, F.lit("]}}}")),
        F.concat(F.lit('{"key":"raw","value":{"bytesValue":"'), F.base64(F.encode("span_id", "UTF-8")), F.lit('"}}')),
    ]


def export_files(spark, sf) -> str:
    """The spans as trace export objects, one per line."""
    spans = derived.spans(spark, sf)
    bag = [_attribute(name, F.col(column)) for column, name in ATTRIBUTE_COLUMNS.items()]
    bag += [
        _attribute(otlp.USER_ATTRIBUTE, F.col("user_id")), _attribute(otlp.APP_ATTRIBUTE, F.col("app_id")),
        _attribute(otlp.CONVERSATION_ATTRIBUTE, F.col("conversation_id")),
    ]
    start = F.unix_micros("start_time")
    end = start + F.round(F.col("duration_ms") * 1000).cast("long")
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"),
        F.col("span_name").alias("name"),
        F.when(F.col("span_kind") == "CLIENT", F.lit("SPAN_KIND_CLIENT")).otherwise("1").alias("kind"),
        F.concat(start.cast("string"), F.lit("000")).alias("startTimeUnixNano"),
        F.concat(end.cast("string"), F.lit("000")).alias("endTimeUnixNano"),
        F.array(*bag).alias("attributes"),
        F.struct(F.when(F.col("status_code") == "ERROR", "2").otherwise("STATUS_CODE_OK").alias("code")).alias("status"),
    )
    resource = F.struct(F.array(_attribute("service.name", F.col("service_name"))).alias("attributes"))
    scopes = F.array(F.struct(F.array(span).alias("spans")))
    export = spans.select("model", "input_tokens", "status_code", "span_id", F.array(F.struct(resource.alias("resource"), scopes.alias("scopeSpans"))).alias("resourceSpans"))
    path = work_path(spark, "export")
    # The list and map values have no one type, so they go into the text of the object.
    whole = F.to_json(F.struct("resourceSpans"))
    mixed = F.concat(F.lit('"attributes":['), *[F.concat(v, F.lit(",")) for v in _kinds_of_values()], F.lit('{"key":"gen_ai'))
    export.select(F.replace(whole, F.lit('"attributes":[{"key":"gen_ai'), mixed).alias("value")).write.text(path)
    return path


OTLP_SHOWN = SHOWN + ["service_name", "span_name", "span_kind", "user_id", "app_id", "conversation_id", "operation_name", "response_id"]


OTLP_NESTED = """
    '["' || status_code || '",' || CAST(input_tokens > 500 AS VARCHAR) || ']' AS finish_reasons,
    '{"model":"' || model || '","tokens":' || input_tokens || ',"said \\"{}\\"":["' || status_code || '",' || CAST(input_tokens > 500 AS VARCHAR) || ']}' AS limits,
    to_base64(encode(span_id)) AS raw"""


@query("flatten_otlp", on_spans("SELECT " + ", ".join(OTLP_SHOWN) + f", {OTLP_NESTED} FROM spans"))
def flatten_otlp(spark, sf):
    bag = F.from_json("attributes", "map<string,string>")
    return otlp.read_otlp(spark, export_files(spark, sf)).select(*OTLP_SHOWN, *(bag[name].alias(name) for name in ("finish_reasons", "limits", "raw")))


@query("write_spans", on_spans("SELECT strftime(start_time, '%Y%m') AS month, provider, count(*) AS span_count FROM spans GROUP BY 1, 2"))
def write_spans(spark, sf):
    stored = spark.read.parquet(stored_spans(spark, sf))
    return stored.groupBy(F.col("month").cast("string").alias("month"), "provider").agg(F.count(F.lit(1)).alias("span_count"))


@query("write_facts", with_(
    "SELECT 'evals' AS table_name, count(*) AS row_count, round(sum(score), 6) AS score_sum FROM raw_evals "
    "UNION ALL SELECT 'drift_scores', count(*), round(sum(score), 6) FROM drift_table "
    "UNION ALL SELECT 'pii_queue', count(*), round(sum(score), 6) FROM queue", EVALS, *DRIFT_TABLE_SQL, *PII, QUEUE))
def write_facts(spark, sf):
    """Three fact tables appended and read back with their schemas."""
    paths = [work_path(spark, name) for name in ("evals", "drift", "queue")]
    append_table(derived.evals(spark, sf), paths[0], EVAL_SCHEMA, "evaluated_at")
    append_table(drift_table(spark, sf), paths[1], DRIFT_SCORES, "score_date", AS_OF)
    jobs.store_queue(pii.triage(derived.answers_only(spark, sf), AS_OF), paths[2], AS_OF)

    def summary(name, path, schema):
        return read_table(spark, path, schema).agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.sum("score").alias("score_sum"))

    return (
        summary("evals", paths[0], EVAL_SCHEMA)
        .unionByName(summary("drift_scores", paths[1], DRIFT_SCORES))
        .unionByName(summary("pii_queue", paths[2], PII_QUEUE))
    )


@query("skip_index_write", on_spans("SELECT span_id, user_id, app_id, conversation_id, start_time FROM spans WHERE user_id = 'user-8'"))
def skip_index_write(spark, sf):
    path = stored_spans(spark, sf, lookup_columns=span_table.LOOKUP_COLUMNS)
    found = search.lookup_spans(span_table.read_spans(spark, path), user_id="user-8")
    return found.select("span_id", "user_id", "app_id", "conversation_id", "start_time")


@query("retention", on_spans(f"SELECT span_id, start_time FROM spans WHERE start_time >= {END} - INTERVAL 14 DAY"))
def retention(spark, sf):
    path = work_path(spark, "spans")
    span_table.write_spans(with_defaults(derived.spans(spark, sf), AS_OF), path)
    apply_retention(spark, path, "spans", AS_OF, days=14)
    return span_table.read_spans(spark, path, ["span_id", "start_time"])


@query("pricing_dim", with_(
    "SELECT p.provider, p.model_name, input_price AS input_cost_per_1k, output_price AS output_cost_per_1k, count(s.span_id) AS span_count "
    f"FROM pricing p LEFT JOIN (SELECT *, {CANONICAL.format('model')} AS k FROM spans) s ON s.provider = p.provider AND s.k = p.model_name GROUP BY 1, 2, 3, 4",
    SPANS, PRICING), digits=9)
def pricing_dim(spark, sf):
    """The price list with the number of spans each row prices directly."""
    used = derived.spans(spark, sf).groupBy("provider", canonical_model("model").alias("model_name")).agg(F.count(F.lit(1)).alias("used"))
    listed = pricing.seed_pricing(spark).select("provider", "model_name", "input_cost_per_1k", "output_cost_per_1k")
    return listed.join(used, ["provider", "model_name"], "left").select(
        *listed.columns, F.coalesce("used", F.lit(0).cast("long")).alias("span_count"))


LINES = [
    "page AS (SELECT unnest(['# HELP llm_eval_score Eval score from LLM evaluation', '# TYPE llm_eval_score gauge', "
    "'', '# HELP llm_request_duration_seconds Request duration in seconds', '# TYPE llm_request_duration_seconds histogram', "
    "'', '# HELP llm_spans_total Total number of spans', '# TYPE llm_spans_total counter']) AS line UNION ALL "
    "SELECT printf('llm_eval_score{model=\"%s\",metric=\"%s\"} %.6f', evaluated_model, metric_name, avg(score)) FROM evals "
    f"WHERE {EVAL_IN_MONTH} GROUP BY evaluated_model, metric_name UNION ALL "
    "SELECT printf('llm_request_duration_seconds_bucket{model=\"%s\",le=\"%s\"} %d', model, le, n) FROM (SELECT model, "
    "unnest(['0.5', '2.0', '5.0', '+Inf']) AS le, unnest([count(*) FILTER (duration_ms / 1000 <= 0.5), count(*) FILTER (duration_ms / 1000 <= 2.0), "
    f"count(*) FILTER (duration_ms / 1000 <= 5.0), count(*)]) AS n FROM spans WHERE start_time >= {END} - INTERVAL 30 DAY GROUP BY model) UNION ALL "
    f"SELECT printf('llm_spans_total %d', count(*)) FROM spans WHERE start_time >= {END} - INTERVAL 30 DAY)",
]


@query("prom_export", with_("SELECT line FROM page", SPANS, EVALS, *LINES))
def prom_export(spark, sf):
    current = derived.current_evals(spark, sf, days=30)
    return exposition(derived.spans(spark, sf), current, AS_OF, days=30).select("line")
