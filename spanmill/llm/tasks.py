"""Python inside tasks: every operator runs its Arrow code through here."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

Batches = Iterator[pa.RecordBatch]


def find_library(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it (or from their own installation)."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def in_arrow(df: DataFrame, run: Callable[[Batches], Batches], schema) -> DataFrame:
    """``df.mapInArrow`` whose workers find this library, in batches that keep rows of long texts small.

    A batch is bounded by its bytes too, on both sides of the pipe. Sizes that the session has set stay.
    """
    spark = df.sparkSession
    find_library(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2000")
    if spark.conf.get(_BATCH_BYTES) == "67108864b":
        spark.conf.set(_BATCH_BYTES, "16m")
    return df.mapInArrow(run, schema)
