"""Dropping expired rows of the stored tables, month by month."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill import schemas
from spanmill.functions import times

TABLES = {
    "spans": schemas.SPANS, "evals": schemas.EVALS, "pii_queue": schemas.PII_QUEUE,
    "drift_scores": schemas.DRIFT_SCORES, "alert_history": schemas.ALERT_HISTORY,
}


class _Folders:
    """Renaming and removing month folders in whatever file system a table lies."""

    def __init__(self, spark: SparkSession, path: str):
        self._paths = spark._jvm.org.apache.hadoop.fs
        self.root = path.rstrip("/")
        self._system = self._paths.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def months(self) -> list[str]:
        names = [status.getPath().getName() for status in self._system.listStatus(self._paths.Path(self.root))]
        return sorted(name.removeprefix("month=") for name in names if name.startswith("month="))

    def move(self, old: str, new: str) -> None:
        if not self._system.rename(self._paths.Path(f"{self.root}/{old}"), self._paths.Path(f"{self.root}/{new}")):
            raise OSError(f"could not move {old} to {new} in {self.root}")

    def make(self, name: str) -> None:
        self._system.mkdirs(self._paths.Path(f"{self.root}/{name}"))

    def remove(self, name: str) -> None:
        self._system.delete(self._paths.Path(f"{self.root}/{name}"), True)


def apply_retention(spark: SparkSession, path: str, table: str, as_of, days: int | None = None) -> list[str]:
    """Drop what is older than ``days`` (by default the table's own) from the table stored at ``path``.

    Months that are wholly expired go as they are; the month of the bound is written anew beside the table, in a folder
    that readers pass over, and the two are swapped by renames, so no reader sees rows twice and a failure leaves
    either the old or the new folder under its hidden name. Younger months are not touched. Returns the months that
    changed.
    """
    ts, kept_days = schemas.RETENTION[table]
    cutoff = times.moment(as_of) - times.interval(days=kept_days if days is None else days)
    bound = spark.range(1).select(times.month_of(cutoff)).first()[0]
    folders = _Folders(spark, path)
    expired = [month for month in folders.months() if month < bound]
    work = f"_retention-{uuid.uuid4().hex}"
    folders.make(work)
    for month in expired:
        folders.move(f"month={month}", f"{work}/expired-{month}")
    if bound in folders.months():
        rows = _month(spark, path, TABLES[table], bound)
        keeps = rows.filter(F.col(ts).cast("timestamp") >= cutoff)
        if not rows.filter(F.coalesce(F.col(ts).cast("timestamp") < cutoff, F.lit(True))).isEmpty():
            keeps.write.parquet(f"{path}/{work}/kept")
            some = not spark.read.schema(TABLES[table]).parquet(f"{path}/{work}/kept").isEmpty()
            folders.move(f"month={bound}", f"{work}/expired-{bound}")
            if some:
                folders.move(f"{work}/kept", f"month={bound}")
            expired.append(bound)
    folders.remove(work)
    return expired


def _month(spark: SparkSession, path: str, schema: T.StructType, month: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/month={month}")
