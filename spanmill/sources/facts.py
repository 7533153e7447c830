"""Append-only fact tables: evals, drift scores, alert history, the triage queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions import times

# Value of a column the incoming rows lack.
_EMPTY = {"string": "", "bigint": 0, "int": 0, "double": 0.0, "boolean": False}


def conform(df: DataFrame, schema: T.StructType, as_of=None) -> DataFrame:
    """``df`` with exactly the columns of ``schema``.

    Missing columns get their default; ``inserted_at`` is ``as_of`` (or the clock);
    other missing dates and times stay null.
    """
    columns = []
    for field in schema.fields:
        kind = field.dataType.simpleString()
        if field.name == "inserted_at" and field.name not in df.columns:
            value = times.moment(as_of) if as_of is not None else F.current_timestamp()
        elif field.name in df.columns:
            value = F.col(field.name)
        elif field.name == "currency":
            value = F.lit("USD")
        elif field.name == "attributes":
            value = F.lit("{}")
        else:
            value = F.lit(_EMPTY.get(kind))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def append_table(df: DataFrame, path: str, schema: T.StructType, ts: str, as_of=None) -> None:
    """Append rows under their month folder.

    Rows go to the writers as they are partitioned already: fact batches are small next
    to the spans, and a shuffle by month would send a whole month to one task.
    """
    (
        conform(df, schema, as_of)
        .withColumn("month", times.month_of(ts))
        .write.mode("append")
        .partitionBy("month")
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    stored = T.StructType(schema.fields + [T.StructField("month", T.StringType())])
    return spark.read.schema(stored).parquet(path).drop("month")
