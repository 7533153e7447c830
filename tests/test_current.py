"""The stored table of newest rows against a full deduplication of all rows ever inserted."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spanmill.operators.latest import latest_per_key
from spanmill.session import work_path
from spanmill.sources import current

KEYS = ["trace_id", "metric_name"]
SCHEMA = "trace_id string, metric_name string, span_id string, score double, evaluated_at timestamp, inserted_at timestamp"


def frame(spark, rows):
    found = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string"))
    return found.withColumns({c: F.col(c).cast("timestamp") for c in ("evaluated_at", "inserted_at")})


def row(trace, metric, month, version, score=0.5, span="s"):
    return (trace, metric, span, score, None if month is None else f"2024-{month:02d}-05 10:00:00", f"2024-09-01 00:00:{version:02d}")


def put(spark, path, rows):
    return current.upsert_current(frame(spark, rows), path, KEYS, "inserted_at", "evaluated_at", "span_id")


def stored(spark, path, **window):
    return sorted(map(tuple, current.read_current(spark, path, frame(spark, []).schema, **window).collect()), key=str)


def full(spark, rows):
    return sorted(map(tuple, latest_per_key(frame(spark, rows), KEYS, "inserted_at", "span_id").collect()), key=str)


def test_any_order_of_inserts_equals_full_dedupe(spark):
    draw = random.Random(4)
    rows = [row(f"t{draw.randint(0, 15)}", f"m{draw.randint(0, 1)}", draw.choice([1, 2, 3, 4, None]), v % 60, draw.random(), f"s{v}") for v in range(120)]
    path = work_path(spark, "current")
    for at in range(0, 120, 30):
        put(spark, path, rows[at : at + 30])
        assert stored(spark, path) == full(spark, rows[: at + 30])
    put(spark, path, rows[30:60])
    assert stored(spark, path) == full(spark, rows)


def test_only_touched_months_are_rewritten(spark):
    path = work_path(spark, "current")
    put(spark, path, [row(f"t{m}", "x", m, 1) for m in (1, 2, 3)])
    _, before = current.FolderLists(spark, path).read()
    assert put(spark, path, [row("t9", "x", 2, 2)]) == ["202402"]
    _, after = current.FolderLists(spark, path).read()
    assert {m for m in before if before[m] != after[m]} == {"202402"}
    # A newer version in another month takes the key out of the old one.
    assert put(spark, path, [row("t1", "x", 3, 5, 0.9)]) == ["202401", "202403"]
    assert sorted(current.FolderLists(spark, path).read()[1]) == ["202402", "202403"]
    # An older version changes nothing, though it touches its own month and that of the newer one.
    assert put(spark, path, [row("t1", "x", 1, 2, 0.1)]) == ["202401", "202403"]
    assert [r[3] for r in stored(spark, path) if r[0] == "t1"] == [0.9]


def test_readers_list_the_months_of_their_window(spark):
    path = work_path(spark, "current")
    put(spark, path, [row(f"t{m}", "x", m, 1) for m in (1, 2, 3, 4)] + [row("none", "x", None, 1)])
    schema = frame(spark, []).schema
    part = current.read_current(spark, path, schema, since="2024-02-10 00:00:00", until="2024-03-01 00:00:00")
    files = part.inputFiles()
    assert files and all("month=202402" in f or "month=202403" in f for f in files)
    assert sorted(r["trace_id"] for r in part.collect()) == ["t2", "t3"]
    assert len(stored(spark, path)) == 5
    assert current.read_current(spark, path, schema, since="2030-01-01 00:00:00").count() == 0


def test_an_upsert_that_dies_is_not_seen(spark, monkeypatch):
    path = work_path(spark, "current")
    put(spark, path, [row("a", "x", 1, 1, 0.1)])
    before = stored(spark, path)
    with monkeypatch.context() as patch:
        patch.setattr(current.FolderLists, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            put(spark, path, [row("a", "x", 1, 2, 0.2)])
    assert stored(spark, path) == before
    # Nor is a list whose write broke off before its success mark.
    spark.createDataFrame([("202401", "data/none")], "month string, folder string").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").json(f"{path}/versions/{2:012d}")
    assert stored(spark, path) == before
    put(spark, path, [row("a", "x", 1, 3, 0.3)])
    assert [r[3] for r in stored(spark, path)] == [0.3]
    assert current.clean(spark, path, keep=1) == 2
    assert [r[3] for r in stored(spark, path)] == [0.3]


def test_a_second_writer_fails(spark):
    path = work_path(spark, "current")
    put(spark, path, [row("a", "x", 1, 1)])
    lists = current.FolderLists(spark, path)
    number, folders = lists.read()
    put(spark, path, [row("b", "x", 1, 1)])
    with pytest.raises(AnalysisException):
        lists.commit(number + 1, folders)


def test_expired_months_and_empty_tables(spark):
    path = work_path(spark, "current")
    assert put(spark, path, []) == [] and stored(spark, path) == []
    put(spark, path, [row(f"t{m}", "x", m, 1) for m in (1, 2, 3)])
    assert current.expire(spark, path, "2024-03-01 00:00:00") == ["202401", "202402"]
    assert [r[0] for r in stored(spark, path)] == ["t3"]
    assert current.expire(spark, path, "2025-01-01 00:00:00") == ["202403"] and stored(spark, path) == []
    assert current.clean(spark, path, keep=1) == 3
