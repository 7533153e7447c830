"""Stored partials of a stream, merged into one folder a day while the stream goes on.

Layout below ``path``: ``run=<stream>/batch=<number>/on_day=<day>`` as the batches write it, and ``_merged`` with the
merged days under ``data/<write>/on_day=<day>`` and numbered lists of what counts. A list names the folder of every
merged day and, for every stream, the last batch that is in them; later batches are read as they are. So a read lists one
folder a day and the batches since the last merge, however long the stream has run.

A merge writes new folders for the days that new batches touch, then the next list. One that dies before its list leaves
folders that no list names, one that dies after it leaves batches that are in the merged days and are no longer read;
``clean_partials`` removes both. The newest batch of a stream, which a restart may write again, is never merged.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.session import settings
from spanmill.sources.current import FolderLists

_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def on_day(at: Column | None) -> Column:
    """The day that a partial is stored under; one for all without ``at``."""
    return F.lit("all") if at is None else F.date_format(at, "yyyy-MM-dd")


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    # Ids and days are texts, also where all of them look like numbers or dates.
    with settings(spark, {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}):
        return spark.read.option("basePath", path).parquet(*folders)


class _Partials:
    """What lies below a path, by name; file contents are not looked at."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.stored, self.lists = FolderLists(spark, self.path), FolderLists(spark, f"{self.path}/_merged")
        self.number, entries = self.lists.read()
        self.days = {k.removeprefix("day="): v for k, v in entries.items() if k.startswith("day=")}
        self.marks = {k.removeprefix("run="): int(v) for k, v in entries.items() if k.startswith("run=")}

    def batches(self) -> dict[str, list[int]]:
        """The numbers of the batches that each stream has stored in full."""
        runs = [n.removeprefix("run=") for n in self.stored.names("") if n.startswith("run=")]
        found = {}
        for run in runs:
            numbers = sorted(int(n.removeprefix("batch=")) for n in self.stored.names(f"run={run}") if n.startswith("batch="))
            found[run] = [n for n in numbers if n <= self.marks.get(run, -1) or "_SUCCESS" in self.stored.names(f"run={run}/batch={n}")]
        return found

    def folders(self, run: str, numbers: Iterable[int]) -> list[tuple[str, str]]:
        """(day, folder) of what batches hold."""
        return [
            (day.removeprefix("on_day="), f"{self.path}/run={run}/batch={number}/{day}")
            for number in numbers for day in self.stored.names(f"run={run}/batch={number}") if day.startswith("on_day=")
        ]

    def live(self) -> list[tuple[str, str]]:
        return [f for run, numbers in self.batches().items() for f in self.folders(run, [n for n in numbers if n > self.marks.get(run, -1)])]


def merge_partials(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], at: Column | None = None) -> list[str]:
    """Bring all but the newest batch of each stream into the merged days; returns the days that were rewritten.

    ``merge`` takes partials to partials of the same columns, one for each key, and must not care how they were grouped
    before; ``at`` is that of the stream. Without new batches nothing is written.
    """
    known = _Partials(spark, path)
    marks, added = dict(known.marks), []
    for run, numbers in known.batches().items():
        fresh = [n for n in numbers[:-1] if n > known.marks.get(run, -1)]
        if fresh:
            added += known.folders(run, fresh)
            marks[run] = fresh[-1]
    if marks == known.marks:
        return []
    touched = sorted({day for day, _ in added})
    days = dict(known.days)
    if touched:
        parts = _read(spark, known.path, [f for _, f in added]).drop("run", "batch", "on_day")
        before = [f"{known.path}/_merged/{known.days[d]}" for d in touched if d in known.days]
        if before:
            parts = parts.unionByName(spark.read.parquet(*before).select(parts.columns))
        write = f"data/{uuid.uuid4().hex}"
        merged = merge(parts).select(parts.columns).withColumn("on_day", on_day(at)).hint("rebalance", "on_day")
        merged.write.partitionBy("on_day").parquet(f"{known.path}/_merged/{write}")
        days |= {d: f"{write}/on_day={d}" for d in touched}
    known.lists.commit(known.number + 1, {f"day={d}": f for d, f in days.items()} | {f"run={r}": str(n) for r, n in marks.items()})
    return touched


def read_merged(spark: SparkSession, path: str, since_day: str | None = None) -> DataFrame | None:
    """Merged days and the batches after them, from ``since_day`` on if given; None if nothing has been merged yet."""
    known = _Partials(spark, path)
    if not known.marks:
        return None

    def wanted(day: str) -> bool:
        return since_day is None or (day != _NO_DAY and day >= since_day)

    live = [f for _, f in known.live()]
    merged = [f"{known.path}/_merged/{f}" for f in known.days.values()]
    shape = (_read(spark, known.path, live[:1]) if live else spark.read.parquet(*merged[:1])).drop("run", "batch", "on_day")
    found = [spark.read.schema(shape.schema).parquet(*folders) for folders in (
        [f"{known.path}/_merged/{f}" for d, f in known.days.items() if wanted(d)], [f for d, f in known.live() if wanted(d)],
    ) if folders]
    if not found:
        return shape.limit(0)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def clean_partials(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove batches that a merge has taken in, folders that none of the newest ``keep`` lists names, and older lists.

    Readers that hold an older list lose their files, so ``keep`` should cover the longest read. Returns the folders
    removed.
    """
    known = _Partials(spark, path)
    numbers = known.lists.complete()
    lists = {n: known.lists.read(n)[1] for n in numbers[-keep:]}
    removed = 0
    # A batch goes once every list that is kept has it in its merged days.
    for run, stored in known.batches().items():
        mark = min((int(entries.get(f"run={run}", -1)) for entries in lists.values()), default=-1)
        for number in stored:
            if number <= mark:
                known.stored.remove(f"run={run}/batch={number}")
                removed += 1
    for number in known.lists.names("versions"):
        if int(number) not in lists and int(number) <= known.number:
            known.lists.remove(f"versions/{number}")
    named = {f for entries in lists.values() for f in entries.values()}
    for write in known.lists.names("data"):
        for day in known.lists.names(f"data/{write}"):
            if day.startswith("on_day=") and f"data/{write}/{day}" not in named:
                known.lists.remove(f"data/{write}/{day}")
                removed += 1
    return removed
