"""The newest row of every key as a stored table by month, kept so by upserts that rewrite only the months they touch.

Layout: rows under ``path/data/<write>/month=<yyyyMM>``, and under ``path/versions/<number>`` the list of folders that
make up the table, one row a month. An upsert writes new folders beside the old ones and then the next list; a list
without its success mark does not count, so a reader sees the table before an upsert or after it, never between, and an
upsert that dies leaves folders that no list names. ``clean`` removes those.

One writer at a time: a second one that started from the same list fails on the number that the first has taken.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanmill.functions import times
from spanmill.operators.latest import latest_per_key
from spanmill.session import cut_lineage


class FolderLists:
    """The numbered lists of folders of a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._system = self._fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        where = self._fs.Path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._system.listStatus(where)) if self._system.exists(where) else []

    def complete(self) -> list[int]:
        return [int(n) for n in self.names("versions") if self._system.exists(self._fs.Path(f"{self.path}/versions/{n}/_SUCCESS"))]

    def read(self, number: int | None = None) -> tuple[int, dict[str, str]]:
        """The newest list (or that of a number): its number, and the folder of each month."""
        known = self.complete()
        if number is None:
            number = known[-1] if known else 0
        if number not in known:
            return number, {}
        rows = self.spark.read.schema("month string, folder string").json(f"{self.path}/versions/{number:012d}").collect()
        return number, {r["month"]: r["folder"] for r in rows if r["month"] is not None}

    def commit(self, number: int, folders: dict[str, str]) -> None:
        # A table without months still has a list, of one row without a month.
        rows = self.spark.createDataFrame(sorted(folders.items()) or [(None, None)], "month string, folder string")
        taken = self._fs.Path(f"{self.path}/versions/{number:012d}")
        if self._system.exists(taken) and number not in self.complete():
            self._system.delete(taken, True)  # left by a writer that died
        rows.coalesce(1).write.mode("errorifexists").json(f"{self.path}/versions/{number:012d}")

    def remove(self, folder: str) -> None:
        self._system.delete(self._fs.Path(f"{self.path}/{folder}"), True)


def _rows(spark: SparkSession, path: str, schema: T.StructType, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{f}" for f in folders])


def upsert_current(rows: DataFrame, path: str, keys: list[str], version: str, ts: str, tie: str | None = None) -> list[str]:
    """Bring ``rows`` into the table at ``path``; returns the months that were rewritten.

    For each key the row with the highest ``version`` stays, then the highest ``tie``, in whatever order rows come; the
    result is that of ``latest_per_key`` over all rows ever given, and giving rows again changes nothing. The month is
    that of ``ts``, which may move with a newer version: the key is then taken out of its old month. To find such keys the
    key columns of the other months are read, and no others. Rows without ``ts`` form a month of their own.
    """
    spark = rows.sparkSession
    lists = FolderLists(spark, path)
    number, folders = lists.read()
    month = F.coalesce(times.month_of(ts), F.lit("none"))
    batch = cut_lineage(latest_per_key(rows, keys, version, tie))
    touched = {r["month"] for r in batch.select(month.alias("month")).distinct().collect()}
    if not touched:
        return []
    others = {m: f for m, f in folders.items() if m not in touched}
    if others:
        stored = _rows(spark, path, rows.schema, list(others.values()))
        met = stored.select(*keys, month.alias("_month")).join(batch.select(*keys), keys, "left_semi")
        touched |= {r["_month"] for r in met.select("_month").distinct().collect()}
    before = _rows(spark, path, rows.schema, [folders[m] for m in sorted(touched) if m in folders])
    merged = latest_per_key(before.unionByName(batch), keys, version, tie).withColumn("month", month)
    write = f"data/{uuid.uuid4().hex}"
    merged.write.partitionBy("month").parquet(f"{path.rstrip('/')}/{write}")
    written = {n.removeprefix("month=") for n in lists.names(write) if n.startswith("month=")}
    kept = {m: f for m, f in folders.items() if m not in touched} | {m: f"{write}/month={m}" for m in written}
    lists.commit(number + 1, kept)
    return sorted(touched)


def read_current(spark: SparkSession, path: str, schema: T.StructType, since=None, until=None) -> DataFrame:
    """The table as of the newest list; with ``since`` or ``until`` only the folders of the months between are listed and read.

    Rows of those months come whole: the time filter itself is the reader's.
    """
    _, folders = FolderLists(spark, path).read()
    if since is not None or until is not None:
        ends = spark.range(1).select(*[F.lit(None).cast("string") if t is None else times.month_of(times.moment(t)) for t in (since, until)]).first()
        folders = {m: f for m, f in folders.items() if m != "none" and (ends[0] is None or m >= ends[0]) and (ends[1] is None or m <= ends[1])}
    return _rows(spark, path, schema, [folders[m] for m in sorted(folders)])


def expire(spark: SparkSession, path: str, before) -> list[str]:
    """Take the months that end before ``before`` off the list; returns them."""
    lists = FolderLists(spark, path)
    number, folders = lists.read()
    bound = spark.range(1).select(times.month_of(times.moment(before))).first()[0]
    gone = sorted(m for m in folders if m != "none" and m < bound)
    if gone:
        lists.commit(number + 1, {m: f for m, f in folders.items() if m not in gone})
    return gone


def clean(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove lists older than the newest ``keep``, and folders that no list left names; returns the folders removed.

    Readers that still hold an older list lose their files, so ``keep`` should cover the longest read.
    """
    lists = FolderLists(spark, path)
    known = lists.complete()
    kept = known[-keep:]
    named = {f for n in kept for f in lists.read(n)[1].values()}
    for n in lists.names("versions"):
        if int(n) not in kept:
            lists.remove(f"versions/{n}")
    removed = 0
    for write in lists.names("data"):
        for month in lists.names(f"data/{write}"):
            if month.startswith("month=") and f"data/{write}/{month}" not in named:
                lists.remove(f"data/{write}/{month}")
                removed += 1
    return removed
