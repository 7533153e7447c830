import json

import pytest
from pyspark.sql import functions as F

from spanmill.operators.normalize import with_defaults
from spanmill.operators.search import lookup_spans, search_traces
from spanmill.schemas import EVALS, RETENTION
from spanmill.session import shared_dir, work_path
from spanmill.sources import facts, otlp, pricing, spans as table
from spanmill.sources.retention import TABLES, apply_retention

AS_OF = "2024-03-01 00:00:00"


@pytest.fixture(scope="module")
def stored(spark):
    df = spark.range(600).select(
        F.col("id").cast("string").alias("span_id"), F.concat(F.lit("t"), F.col("id") % 100).alias("trace_id"),
        F.concat(F.lit("u"), F.col("id") % 7).alias("user_id"), F.lit("openai").alias("provider"), F.lit("gpt-4o").alias("model"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 8640).alias("start_time"),
    )
    path = work_path(spark, "stored")
    table.write_spans(with_defaults(df, AS_OF), path, lookup_columns=table.LOOKUP_COLUMNS)
    return path


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_read_prunes_months_and_columns(spark, stored):
    df = table.read_spans(spark, stored, ["span_id", "start_time"], start="2024-02-10 00:00:00")
    assert df.count() == 200
    text = plan(df)
    assert "month#" in text and "202402" in text
    assert "ReadSchema: struct<span_id:string,start_time:timestamp>" in text
    assert "GreaterThanOrEqual(start_time" in text


def test_lookup_reaches_the_scan(spark, stored):
    found = lookup_spans(table.read_spans(spark, stored), user_id="u3")
    assert "EqualTo(user_id,u3)" in plan(found)
    assert found.count() == len([i for i in range(600) if i % 7 == 3])


def test_top_k_is_not_a_full_sort(spark, stored):
    assert "TakeOrderedAndProject" in plan(search_traces(table.read_spans(spark, stored), provider="openai"))


def test_retention_keeps_the_bound(spark, stored):
    kept = table.retain(table.read_spans(spark, stored), "start_time", 10, AS_OF)
    assert kept.agg(F.min("start_time")).first()[0].isoformat() == "2024-02-20T00:00:00"


def test_boundary_month_is_rewritten_alone(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("span_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 86400).alias("start_time"))
    path = work_path(spark, "retained")
    table.write_spans(with_defaults(df, AS_OF), path)
    assert apply_retention(spark, path, "spans", "2024-03-01 00:00:00", days=20) == ["202401", "202402"]
    left = table.read_spans(spark, path)
    assert left.count() == 20 and str(left.agg(F.min("start_time")).first()[0]) == "2024-02-10 00:00:00"
    assert apply_retention(spark, path, "spans", "2024-03-01 00:00:00", days=20) == []
    assert apply_retention(spark, path, "spans", "2024-06-01 00:00:00", days=20) == ["202402"]


@pytest.mark.parametrize("name", ["evals", "pii_queue", "drift_scores", "alert_history"])
def test_retention_of_fact_tables(spark, name):
    ts, days = RETENTION[name]
    path, schema = work_path(spark, name), TABLES[name]
    rows = spark.range(40).select(F.timestamp_seconds(F.lit(1717200000) - F.col("id") * 86400 * 20).cast(schema[ts].dataType).alias(ts))
    facts.append_table(rows, path, schema, ts, AS_OF)
    before = facts.read_table(spark, path, schema).count()
    apply_retention(spark, path, name, "2024-06-01 00:00:00")
    left = facts.read_table(spark, path, schema)
    young = rows.filter(F.col(ts).cast("timestamp") >= F.lit("2024-06-01").cast("timestamp") - F.expr(f"INTERVAL {days} DAY")).count()
    assert left.count() == young < before == 40


def test_facts_get_their_schema_and_defaults(spark):
    path = work_path(spark, "facts")
    rows = spark.createDataFrame([("t", 0.5)], "trace_id string, score double").withColumn("evaluated_at", F.lit("2024-01-02").cast("timestamp"))
    facts.append_table(rows, path, EVALS, "evaluated_at", AS_OF)
    facts.append_table(rows, path, EVALS, "evaluated_at", AS_OF)
    back = facts.read_table(spark, path, EVALS)
    assert back.count() == 2 and back.columns == EVALS.names
    row = back.first()
    assert row.reason == "" and str(row.inserted_at) == AS_OF


def test_pricing_csv(spark):
    path = work_path(spark, "prices")
    pricing.seed_pricing(spark).write.option("header", True).csv(path)
    assert pricing.read_pricing(spark, path).count() == 20


def _any_value(value):
    """A Python value as the protocol writes it."""
    if value is None:
        return {}
    if isinstance(value, bool):
        return {"boolValue": value}
    if isinstance(value, int):
        return {"intValue": str(value)}
    if isinstance(value, float):
        return {"doubleValue": value}
    if isinstance(value, str):
        return {"stringValue": value}
    if isinstance(value, list):
        return {"arrayValue": {"values": [_any_value(v) for v in value]} if value else {}}
    return {"kvlistValue": {"values": [{"key": k, "value": _any_value(v)} for k, v in value.items()]}}


NESTED = [
    [], ["stop"], ["a", 1, 2.5, True, None], {"k": "v"}, {}, [[], [[1], [2, [3, {"x": [{}]}]]]],
    {"deep": {"er": [{"a": 1}, {"b": [None, "]}}"]}]}, "q\"uo{}te": "back\\\\slash {\"stringValue\":\"x\"}"},
    ["{}", "[", "]}}", "\\", "$1 \n\t", '{"arrayValue":{"values":[', "é😀"], [{"n": -5}] * 300, ["x " * 20_000, "y"],
]


@pytest.mark.parametrize("indent", [None, 2])
def test_nested_values_become_plain_json(spark, indent):
    raw = [(i, json.dumps(_any_value(v), indent=indent)) for i, v in enumerate(NESTED)]
    found = spark.createDataFrame(raw, "i int, v string").select("i", otlp.plain_json(F.col("v")).alias("v")).collect()
    assert {r.i: json.loads(r.v) for r in found} == dict(enumerate(NESTED))


def test_every_kind_of_value_is_read_from_a_file(spark, tmp_path):
    attributes = [{"key": f"k{i}", "value": _any_value(v)} for i, v in enumerate(NESTED)] + [{"key": "b", "value": {"bytesValue": "AAEC"}}, {"key": "none", "value": {}}]
    span = {"traceId": "ab" * 16, "spanId": "cd" * 8, "name": "chat", "startTimeUnixNano": "1", "endTimeUnixNano": "2", "attributes": attributes}
    (tmp_path / "a.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}) + "\n")
    bag = json.loads(otlp.read_otlp(spark, str(tmp_path)).first().attributes)
    assert [json.loads(bag[f"k{i}"]) for i in range(len(NESTED))] == NESTED
    assert bag["b"] == "AAEC" and bag.get("none") is None


def test_export_file(spark, tmp_path):
    text = lambda k, v: {"key": k, "value": {"stringValue": v}}
    span = {
        "traceId": "ab" * 16, "spanId": "cd" * 8, "name": "chat", "kind": 3, "status": {"code": 2, "message": "late"},
        "startTimeUnixNano": "1704067200000000000", "endTimeUnixNano": "1704067201500000000",
        "attributes": [text("gen_ai.provider.name", "openai"), text("gen_ai.request.model", "gpt-4o"),
                       {"key": "gen_ai.usage.input_tokens", "value": {"intValue": "12"}}, text("gen_ai.usage.output_tokens", "x"),
                       text("dup", "1"), text("dup", "2")],
    }
    bare = {"traceId": "ef" * 16, "spanId": "01" * 8, "name": "bare", "kind": "SPAN_KIND_SERVER"}
    export = {"resourceSpans": [{"resource": {"attributes": [text("service.name", "svc")]}, "scopeSpans": [{"spans": [span]}, {"spans": [bare]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(export) + "\n")
    rows = {r.span_name: r for r in otlp.read_otlp(spark, str(tmp_path)).collect()}
    full = rows["chat"]
    assert (full.service_name, full.span_kind, full.status_code, full.status_message) == ("svc", "CLIENT", "ERROR", "late")
    assert (full.provider, full.model, full.input_tokens, full.output_tokens, full.total_tokens) == ("openai", "gpt-4o", 12, 0, 12)
    assert full.duration_ms == 1500.0 and str(full.start_time) == "2024-01-01 00:00:00"
    assert json.loads(full.attributes)["dup"] == "2"
    assert (rows["bare"].span_kind, rows["bare"].status_code, rows["bare"].parent_span_id, rows["bare"].provider) == ("SERVER", "UNSET", "", "")
    streamed = otlp.stream_otlp(spark, str(tmp_path))
    assert streamed.isStreaming and streamed.columns == otlp.read_otlp(spark, str(tmp_path)).columns
