"""One JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


# The writer's own format would cut times to milliseconds.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**_TIMES).json(path)


def write_json_rows(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).options(**_TIMES).json(path)
