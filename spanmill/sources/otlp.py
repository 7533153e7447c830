"""OTLP/JSON export files (traces) to span rows, in batch or on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions.genai import attribute, genai_columns
from spanmill.schemas import SPANS

_ATTRIBUTES = (
    "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:string,"
    "boolValue:string,bytesValue:string,arrayValue:string,kvlistValue:string>>>"
)
_SPAN = (
    "struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,"
    "startTimeUnixNano:string,endTimeUnixNano:string,"
    f"attributes:{_ATTRIBUTES},status:struct<code:string,message:string>>"
)
EXPORT = (
    f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,"
    f"scopeSpans:array<struct<spans:array<{_SPAN}>>>>>"
)

# Protocol enums by number; files may also spell out the name.
KINDS = ["UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"]
STATUSES = ["UNSET", "OK", "ERROR"]
USER_ATTRIBUTE = "user.id"
APP_ATTRIBUTE = "app.id"
CONVERSATION_ATTRIBUTE = "gen_ai.conversation.id"


def _keep_last_of_repeated_keys(spark: SparkSession) -> None:
    """The protocol forbids repeated keys in a span; a bad span must not fail the job."""
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    _keep_last_of_repeated_keys(spark)
    return flatten_otlp(spark.read.schema(EXPORT).json(path))


def stream_otlp(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    _keep_last_of_repeated_keys(spark)
    files = spark.readStream.schema(EXPORT).option("maxFilesPerTrigger", max_files).json(path)
    return flatten_otlp(files)


# A JSON text never holds these control characters as they are, so they can stand for parts that are read already.
_LIST, _MAP, _NOTHING = "\u0001", "\u0002", "\u0007"
_READ = {"[": "\u0003", "]": "\u0004", "{": "\u0005", "}": "\u0006"}
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_SETTLED = rf'(?:[^"\[\]{{}}{_LIST}{_MAP}]++|{_STRING})*+'


def plain_json(value: Column) -> Column:
    """The JSON text of a nested attribute value without the names of its kinds, to any depth.

    ``{"arrayValue":{"values":[{"intValue":"1"},{"kvlistValue":...}]}}`` becomes ``[1,{...}]``. Lists and maps that hold
    nothing nested are rewritten first, all of them in one step, then those around them. Bytes keep their base64 text,
    an empty value is null, and a text that does not have this form stays as far as it cannot be read.
    """
    text = F.regexp_replace(value, rf"({_STRING})|\s+", "$1")
    text = F.regexp_replace(text, rf"({_STRING})|\{{\}}", f"$1{_NOTHING}")
    text = F.regexp_replace(F.regexp_replace(text, rf'({_STRING}){_NOTHING}', "$1"), _NOTHING, "null")
    text = F.regexp_replace(text, rf'\{{"(?:string|bytes|double)Value":({_STRING})\}}', "$1")
    text = F.regexp_replace(text, r'\{"intValue":"?(-?[0-9]+)"?\}', "$1")
    text = F.regexp_replace(text, r'\{"(?:double|bool)Value":([-+.0-9A-Za-z]+)\}', "$1")
    for kind, sign, ends in (("array", _LIST, "[]"), ("kvlist", _MAP, "{}")):
        text = F.regexp_replace(text, rf'\{{"{kind}Value":(?:null|\{{"values":null\}})\}}', _READ[ends[0]] + _READ[ends[1]])
        text = F.regexp_replace(text, rf'\{{"{kind}Value":\{{"values":\[', sign)

    def step(text: Column, _: Column) -> Column:
        text = F.regexp_replace(text, rf'\{{"key":({_STRING})\}}', "$1:null")
        text = F.regexp_replace(text, rf'\{{"key":({_STRING}),"value":({_SETTLED})\}}', "$1:$2")
        text = F.regexp_replace(text, rf"{_LIST}({_SETTLED})\]\}}\}}", f"{_READ['[']}$1{_READ[']']}")
        return F.regexp_replace(text, rf"{_MAP}({_SETTLED})\]\}}\}}", f"{_READ['{']}$1{_READ['}']}")

    def once_more(text: Column, turn: Column) -> Column:
        return F.when(text.rlike(f"[{_LIST}{_MAP}]"), step(text, turn)).otherwise(text)

    # No deeper than the number of lists and maps; what is settled before takes a look only.
    nested = F.length(text) - F.length(F.translate(text, _LIST + _MAP, ""))
    text = F.aggregate(F.sequence(F.lit(1), F.greatest(nested, F.lit(1))), text, once_more)
    return F.translate(text, "".join(_READ.values()), "".join(_READ))


def attribute_map(entries: Column) -> Column:
    """Key/value entries as ``map<string,string>``, whatever kind a value has; lists and maps become plain JSON."""
    present = F.filter(F.coalesce(entries, F.array()), lambda e: e["key"].isNotNull())
    return F.map_from_entries(
        F.transform(
            present,
            lambda e: F.struct(
                e["key"].alias("key"),
                F.coalesce(
                    e["value"]["stringValue"],
                    e["value"]["intValue"],
                    e["value"]["doubleValue"],
                    e["value"]["boolValue"],
                    e["value"]["bytesValue"],
                    *(
                        plain_json(F.concat(F.lit(f'{{"{kind}":'), e["value"][kind], F.lit("}")))
                        for kind in ("arrayValue", "kvlistValue")
                    ),
                ).alias("value"),
            ),
        )
    )


def _enum(value: Column, names: list[str], prefix: str) -> Column:
    # A number that names nothing counts as unspecified.
    by_number = F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), F.coalesce(value.try_cast("int"), F.lit(0))), F.lit(names[0]))
    return F.when(value.rlike("^[0-9]+$"), by_number).otherwise(
        F.coalesce(F.regexp_replace(value, f"^{prefix}", ""), F.lit(names[0]))
    )


def _nanos(value: Column) -> Column:
    return F.timestamp_micros((value.try_cast("decimal(20,0)") / 1000).cast("long"))


def flatten_otlp(exports: DataFrame) -> DataFrame:
    """Export objects to span rows; three explodes and no shuffle."""
    spans = (
        exports.select(F.explode("resourceSpans").alias("r"))
        .select(
            attribute_map(F.col("r.resource.attributes")).alias("resource"),
            F.explode("r.scopeSpans").alias("scope"),
        )
        .select("resource", F.explode("scope.spans").alias("s"))
        .select("resource", "s", attribute_map(F.col("s.attributes")).alias("bag"))
    )
    bag = F.col("bag")
    start, end = _nanos(F.col("s.startTimeUnixNano")), _nanos(F.col("s.endTimeUnixNano"))
    values = {
        "trace_id": F.col("s.traceId"),
        "span_id": F.col("s.spanId"),
        "parent_span_id": F.coalesce(F.col("s.parentSpanId"), F.lit("")),
        "service_name": F.coalesce(attribute(F.col("resource"), "service.name"), F.lit("")),
        "span_name": F.col("s.name"),
        "span_kind": _enum(F.col("s.kind"), KINDS, "SPAN_KIND_"),
        "status_code": _enum(F.coalesce(F.col("s.status.code"), F.lit("0")), STATUSES, "STATUS_CODE_"),
        "status_message": F.coalesce(F.col("s.status.message"), F.lit("")),
        "user_id": F.coalesce(attribute(bag, USER_ATTRIBUTE), F.lit("")),
        "app_id": F.coalesce(attribute(bag, APP_ATTRIBUTE), F.lit("")),
        "conversation_id": F.coalesce(attribute(bag, CONVERSATION_ATTRIBUTE), F.lit("")),
        "start_time": start,
        "end_time": end,
        "duration_ms": (F.unix_micros(end) - F.unix_micros(start)) / 1000.0,
        "cost_usd": F.lit(0.0),
        "attributes": F.to_json(bag),
        "inserted_at": F.current_timestamp(),
    }
    values.update(genai_columns(bag))
    return spans.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in SPANS.fields])
