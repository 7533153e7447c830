"""The span table: parquet, one folder per month, sorted inside its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions import times
from spanmill.schemas import SPANS

SORT_KEY = ["provider", "model", "start_time", "trace_id"]
LOOKUP_COLUMNS = ["user_id", "app_id", "model", "conversation_id", "provider"]
_STORED = T.StructType(SPANS.fields + [T.StructField("month", T.StringType())])


def read_spans(spark: SparkSession, path: str, cols: list[str] | None = None, start=None, end=None) -> DataFrame:
    """The span table, projected, for ``start <= start_time < end``.

    A bound on ``start_time`` alone would open every month folder, so the same bound is
    put on the partition value too.
    """
    df = spark.read.schema(_STORED).parquet(path)
    if start is not None:
        lower = times.moment(start)
        df = df.filter((F.col("start_time") >= lower) & (F.col("month") >= times.month_of(lower)))
    if end is not None:
        upper = times.moment(end)
        df = df.filter((F.col("start_time") < upper) & (F.col("month") <= times.month_of(upper)))
    return df.select(*(cols or SPANS.names))


def write_spans(df: DataFrame, path: str, mode: str = "append", lookup_columns: list[str] | None = None) -> None:
    """Append spans by month, clustered by the sort key.

    Ranges over (month, sort key) rather than a hash of the month: a busy month is spread
    over many tasks and files, and every file covers a narrow key range.
    ``lookup_columns`` get parquet bloom filters for point lookups.
    """
    order = ["month", *SORT_KEY]
    writer = (
        df.withColumn("month", times.month_of("start_time"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .partitionBy("month")
    )
    for column in lookup_columns or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def retain(df: DataFrame, ts: str, days: int, as_of) -> DataFrame:
    """Rows younger than ``days``; the bound is inclusive."""
    return df.filter(F.col(ts) >= times.moment(as_of) - times.interval(days=days))
