"""Results of batches, each in a slot of its own, so that a batch that is run again replaces what it wrote.

Layout: ``path/slot=<slot>/month=<yyyyMM>``. A slot is written whole or not at all: rows that are looked up while a slot
is filled leave that slot out, so a rerun sees what its first run saw.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions import times


def months_of(rows: DataFrame, ts: str) -> list[str]:
    """The months that rows touch: a few, however many rows there are."""
    found = rows.select(times.month_of(ts).alias("month")).distinct().collect()
    return sorted(r["month"] for r in found if r["month"] is not None)


def write_slot(rows: DataFrame, path: str, slot: str, ts: str) -> None:
    rows.withColumn("month", times.month_of(ts)).write.mode("overwrite").partitionBy("month").parquet(f"{path}/slot={slot}")


def read_slots(
    spark: SparkSession, path: str, schema: T.StructType, months: Iterable[str] | None = None, without: str | None = None
) -> DataFrame:
    """Rows of all slots, of the folders of ``months`` only if given; an absent table is empty."""
    stored = T.StructType([*schema.fields, T.StructField("slot", T.StringType()), T.StructField("month", T.StringType())])
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(stored).parquet(path)
    if months is not None:
        rows = rows.filter(F.col("month").isin(*months))
    if without is not None:
        rows = rows.filter(F.col("slot") != without)
    return rows.drop("slot", "month")
