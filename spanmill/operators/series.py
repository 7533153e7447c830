"""Time series on a fixed step: trailing ratios and conditions that hold for a while.

Everything here works on rows already aggregated per (series, tick). A series has at most
one row per tick, so a window over it is bounded by time, not by traffic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanmill.functions import times


def to_ticks(df: DataFrame, ts: str, keys: list[str], step_seconds: int, **sums: Column) -> DataFrame:
    """Sums per (keys, tick); a tick is the end of its step, in epoch seconds."""
    tick = times.tick_of(ts, step_seconds).alias("tick")
    return df.groupBy(*keys, tick).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def on_ticks_within(ticks: DataFrame, keys: list[str], step_seconds: int, width_seconds: int, sums: list[str]) -> DataFrame:
    """The same series with a zero row for each silent tick up to ``width_seconds`` after a sample, and not after the last.

    Beyond that a trailing window is empty, so one stray early sample costs a few rows and not a row for every tick since.
    """
    last = F.max("tick").over(W.partitionBy(*keys))
    reach = F.sequence("tick", F.least(F.col("tick") + width_seconds, F.col("_last")), F.lit(step_seconds).cast("long"))
    grid = ticks.select(*keys, "tick", last.alias("_last")).select(*keys, F.explode(reach).alias("tick")).distinct()
    return grid.join(ticks, [*keys, "tick"], "left").fillna(0, sums)


def trailing(
    ticks: DataFrame, keys: list[str], step_seconds: int, width_seconds: int, sums: list[str]
) -> DataFrame:
    """Sums over the ``width_seconds`` up to each tick."""
    dense = on_ticks_within(ticks, keys, step_seconds, width_seconds, sums)
    window = W.partitionBy(*keys).orderBy("tick").rangeBetween(step_seconds - width_seconds, W.currentRow)
    return dense.withColumns({s: F.sum(s).over(window) for s in sums})


def sliding_ratio(
    df: DataFrame, ts: str, keys: list[str], part: Column, whole: Column, step_seconds: int, width_seconds: int
) -> DataFrame:
    """``sum(part) / sum(whole)`` over a trailing window at each tick, null over nothing.

    Rows are summed once per tick and the ticks are added up; a sliding ``window()``
    would copy each row once per overlapping window instead.
    """
    ticks = to_ticks(df, ts, keys, step_seconds, part=part, whole=whole)
    sums = trailing(ticks, keys, step_seconds, width_seconds, ["part", "whole"])
    return sums.select(
        *keys, "tick", F.timestamp_seconds("tick").alias("ts"), "part", "whole",
        F.when(F.col("whole") > 0, F.col("part") / F.col("whole")).alias("value"),
    )


def sustained(
    series: DataFrame, keys: list[str], step_seconds: Column | int, for_seconds: Column | int,
    holds: Column, tick: str = "tick",
) -> DataFrame:
    """Stretches of consecutive ticks on which ``holds`` is true.

    One row per stretch: first and last tick, number of ticks, whether it lasted
    ``for_seconds``, the tick it fired at, and the next tick of the series after it. A
    missing tick ends a stretch. Ticks on a fixed step minus their row number stay equal
    along a stretch, so one ordered window finds them.
    """
    step = step_seconds if isinstance(step_seconds, Column) else F.lit(step_seconds)
    wait = for_seconds if isinstance(for_seconds, Column) else F.lit(for_seconds)
    in_series = W.partitionBy(*keys).orderBy(tick)
    marked = (
        series.withColumns({"_step": step.cast("long"), "_wait": wait.cast("long"), "_holds": F.coalesce(holds, F.lit(False))})
        .withColumn("_next", F.lead(tick).over(in_series))
        .filter("_holds")
        .withColumn("_island", F.col(tick) - F.row_number().over(in_series) * F.col("_step"))
    )
    stretches = marked.groupBy(*keys, "_island").agg(
        F.min(tick).alias("start_tick"),
        F.max(tick).alias("end_tick"),
        F.count(F.lit(1)).alias("ticks"),
        F.max_by("_next", tick).alias("next_tick"),
        F.first("_step").alias("_step"),
        F.first("_wait").alias("_wait"),
    )
    fired = F.col("end_tick") - F.col("start_tick") >= F.col("_wait")
    return stretches.withColumn(
        "fired_tick", F.when(fired, F.col("start_tick") + F.col("_wait"))
    ).select(
        *keys, "start_tick", "end_tick", "ticks", fired.alias("fired"), "fired_tick", "next_tick",
        F.col("_step").alias("step_seconds"),
    )
