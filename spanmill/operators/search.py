"""Trace search, point lookups and the selections the jobs start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions import times
from spanmill.functions.sampling import hash_keep

TRACE_COLUMNS = [
    "trace_id", "span_id", "parent_span_id", "service_name", "span_name", "span_kind",
    "status_code", "provider", "model", "input_tokens", "output_tokens", "duration_ms", "start_time",
]
SORTABLE = ("start_time", "duration_ms", "input_tokens", "output_tokens")


def _listing(df: DataFrame) -> DataFrame:
    """The listed columns, start time as text (formatted last, after filter and sort)."""
    return df.select(
        *[times.format_ts(c).alias(c) if c == "start_time" else F.col(c) for c in TRACE_COLUMNS]
    )


def _matching(df: DataFrame, **equal: str | None) -> DataFrame:
    for column, value in equal.items():
        if value:
            df = df.filter(F.col(column) == value)
    return df


def search_traces(
    df: DataFrame, model: str | None = None, provider: str | None = None,
    status: str | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of spans, newest first; start times repeat, so the span id breaks ties."""
    return search_time_range(df, model=model, provider=provider, status=status, limit=limit, offset=offset)


def search_time_range(
    df: DataFrame, start=None, end=None, sort: str = "start_time", descending: bool = True,
    model: str | None = None, provider: str | None = None, status: str | None = None,
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    """``search_traces`` between two times and with a chosen sort column."""
    if sort not in SORTABLE:
        raise ValueError(f"sort must be one of {SORTABLE}")
    df = _matching(df, model=model, provider=provider, status_code=status)
    if start is not None:
        df = df.filter(F.col("start_time") >= times.moment(start))
    if end is not None:
        df = df.filter(F.col("start_time") < times.moment(end))
    key = F.col(sort).desc() if descending else F.col(sort).asc()
    page = df.orderBy(key, "span_id")
    if offset:
        page = page.offset(offset)
    return _listing(page.limit(limit))


def trace_spans(df: DataFrame, trace_id: str) -> DataFrame:
    """Every span of one trace by start time."""
    return _listing(df.filter(F.col("trace_id") == trace_id).orderBy("start_time", "span_id"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def distinct_models(df: DataFrame) -> DataFrame:
    return distinct_values(df, "model")


def distinct_providers(df: DataFrame) -> DataFrame:
    return distinct_values(df, "provider")


def lookup_spans(
    df: DataFrame, user_id: str | None = None, app_id: str | None = None, conversation_id: str | None = None
) -> DataFrame:
    """Point lookup; the equalities reach the parquet bloom filters and statistics."""
    return _matching(df, user_id=user_id, app_id=app_id, conversation_id=conversation_id)


def _newest(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(F.col("start_time").desc(), "span_id").limit(limit)


def recent_client_spans(df: DataFrame, as_of, limit: int | None = None, **width: int) -> DataFrame:
    """The client spans of the last 15 minutes; a limit takes the newest, in order."""
    recent = times.within("start_time", as_of, **(width or {"minutes": 15}))
    return _newest(df.filter(recent & (F.col("span_kind") == "CLIENT")), limit)


def is_retrieval_service(service: str = "service_name") -> Column:
    return F.col(service).contains("langchain") | F.col(service).contains("llamaindex")


def rag_spans(df: DataFrame, as_of, limit: int | None = None, **width: int) -> DataFrame:
    """The spans of retrieval services in the last 15 minutes; a limit takes the newest, in order."""
    recent = times.within("start_time", as_of, **(width or {"minutes": 15}))
    return _newest(df.filter(recent & is_retrieval_service()), limit)


def recent_prompts(
    df: DataFrame, as_of, text: str = "span_name", limit: int | None = None, salt: str = "prompt", **width: int
) -> DataFrame:
    """Non-empty client texts of the last 7 days, or ``limit`` of them.

    Which ones is then decided by the hash of the span id, so that a rerun takes the same.
    """
    recent = times.within("start_time", as_of, **(width or {"days": 7}))
    kept = df.filter(recent & (F.col("span_kind") == "CLIENT") & (F.col(text) != ""))
    if limit is not None:
        kept = kept.orderBy(F.md5(F.concat(F.lit(salt), F.col("span_id"))), "span_id").limit(limit)
    return kept


def hash_sample(df: DataFrame, key: str, rate: float, salt: str = "") -> DataFrame:
    return df.filter(hash_keep(key, rate, salt))
