"""Merging of stored partials: what is read stays the same, few folders are listed, and a crash loses and doubles nothing."""

import pytest
from pyspark.sql import functions as F

from spanmill.session import work_path
from spanmill.sources.current import FolderLists
from spanmill.streaming import merging
from spanmill.streaming.rollups import read_partials


def at():
    return F.timestamp_seconds(F.col("tick"))


def store(spark, path, run, batch, rows):
    """A batch as the stream writes it: (tick, n) rows."""
    frame = spark.createDataFrame(rows, "tick bigint, n bigint").withColumn("on_day", merging.on_day(at()))
    frame.write.mode("overwrite").partitionBy("on_day").parquet(f"{path}/run={run}/batch={batch}")


def add(parts):
    return parts.groupBy("tick").agg(F.sum("n").alias("n"))


def totals(spark, path, since=None):
    return {r.tick: r.n for r in read_partials(spark, path, since).groupBy("tick").agg(F.sum("n").alias("n")).collect()}


def merge(spark, path):
    return merging.merge_partials(spark, path, add, at())


def live_folders(spark, path):
    return [f for _, f in merging._Partials(spark, path).live()]


DAY = 86400


def filled(spark):
    """Two streams of several batches over three days, an empty batch, and one row without a time."""
    path, expected = work_path(spark, "partials"), {}
    for run in ("a", "1"):
        for batch in range(5):
            rows = [] if batch == 2 else [(DAY * (k % 3) + k % 2, 10 * batch + k) for k in range(4)] + [(None, 1)]
            store(spark, path, run, batch, rows)
            for tick, n in rows:
                expected[tick] = expected.get(tick, 0) + n
    return path, expected


def test_merged_days_read_as_before(spark):
    path, expected = filled(spark)
    assert totals(spark, path) == expected
    assert merge(spark, path) == ["1970-01-01", "1970-01-02", "1970-01-03", merging._NO_DAY]
    assert totals(spark, path) == expected
    assert merge(spark, path) == []
    # The newest batch of each stream is still read by itself, all others are in one folder a day.
    assert all("batch=4" in f for f in live_folders(spark, path)) and len(merging._Partials(spark, path).days) == 4
    assert totals(spark, path, "1970-01-03 05:00:00") == {k: n for k, n in expected.items() if k is not None and k >= 2 * DAY}
    assert totals(spark, path, "1971-01-01 00:00:00") == {}
    assert merging.clean_partials(spark, path, keep=1) == 8
    assert totals(spark, path) == expected
    # Late rows of an old day, and a batch that is written again.
    store(spark, path, "a", 5, [(0, 1000)])
    store(spark, path, "a", 6, [(5 * DAY, 7)])
    store(spark, path, "a", 6, [(5 * DAY, 7)])
    expected[0] += 1000
    expected[5 * DAY] = 7
    assert totals(spark, path) == expected
    # The last batch of the first round goes in now, so all its days are touched.
    assert merge(spark, path) == ["1970-01-01", "1970-01-02", "1970-01-03", merging._NO_DAY]
    assert totals(spark, path) == expected
    merging.clean_partials(spark, path, keep=1)
    assert totals(spark, path) == expected
    files = [p for p in FolderLists(spark, f"{path}/_merged").names("data")]
    assert files and len(FolderLists(spark, f"{path}/_merged").names("versions")) == 1


def test_a_merge_that_dies_changes_nothing(spark, monkeypatch):
    path, expected = filled(spark)
    with monkeypatch.context() as patch, pytest.raises(OSError, match="lost"):
        patch.setattr(FolderLists, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        merge(spark, path)
    assert totals(spark, path) == expected
    merge(spark, path)
    # Merged, but the batches are not removed yet.
    assert totals(spark, path) == expected
    assert merging.clean_partials(spark, path, keep=1) >= 8
    assert totals(spark, path) == expected


def test_only_touched_days_are_rewritten(spark):
    path, _ = filled(spark)
    merge(spark, path)
    before = dict(merging._Partials(spark, path).days)
    store(spark, path, "b", 0, [(DAY, 5)])
    store(spark, path, "b", 1, [(DAY, 6)])
    assert merge(spark, path) == ["1970-01-02"]
    after = merging._Partials(spark, path).days
    assert {d for d in after if after[d] != before.get(d)} == {"1970-01-02"}


def test_batches_in_flight_are_left_alone(spark):
    path, expected = filled(spark)
    merge(spark, path)
    store(spark, path, "a", 5, [(0, 1)])
    FolderLists(spark, path).remove("run=a/batch=5/_SUCCESS")
    assert totals(spark, path) == expected
    assert merge(spark, path) == []
