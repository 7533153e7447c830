"""Session set-up and the shared work folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "spanmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on (UTC, AQE, skew joins)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture costs several JVM round trips for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone: every timestamp here is UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, taken from ``spark.checkpoint.dir``.

    Only a local session may do without the setting: it gets a folder beside the session's
    warehouse. On a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        sc.setCheckpointDir(f"{warehouse}/spanmill-work-{uuid.uuid4().hex}")
        current = sc.getCheckpointDir()
    return current


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the length of a block."""
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; survives the loss of executors."""
    return counted_copy(df, F.lit(False))[0]


def counted_copy(df: DataFrame, condition: Column) -> tuple[DataFrame, int, int]:
    """``cut_lineage`` with the number of rows, and of rows meeting ``condition``.

    Both are counted by the job that writes. A written table, unlike an RDD checkpoint,
    is columnar and compressed, and tells the optimizer its size.
    """
    spark = df.sparkSession
    path = work_path(spark, "step")
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(condition).alias("hits"))
    observed.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"], seen.get["hits"]


def small_copy(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``cut_lineage`` of narrow rows, which are read back as one partition if there are at most ``max_rows``.

    Joins and groups among such tables need no shuffle of many empty partitions; larger
    tables stay dealt out as they are.
    """
    copy, rows, _ = counted_copy(df, F.lit(False))
    return copy.coalesce(1) if rows <= max_rows else copy


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """A written copy of ``df``, marked for broadcast if it has at most ``max_rows`` rows.

    For narrow results whose size the optimizer cannot know beforehand; a larger one
    keeps Spark's own (shuffle) join.
    """
    copy, rows, _ = counted_copy(df, F.lit(False))
    return F.broadcast(copy) if rows <= max_rows else copy
