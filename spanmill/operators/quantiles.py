"""Exact interpolated quantiles without sending a group to one task.

``percentile`` keeps a value map per group. Here a first narrow pass counts fine
logarithmic buckets (a few thousand per group, combined map-side), which tells in which
bucket each wanted rank lies; a second pass looks only at the values of those buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanmill.session import broadcast_if_small

# Buckets per doubling of the value: each is about 0.07 % wide.
RESOLUTION = 1024
_SHIFT = 1100 * RESOLUTION


def _bucket(value: Column) -> Column:
    """Bucket number that never falls as the value rises; zero and each infinity have one of their own."""
    infinite = F.lit(float("inf"))
    finite = F.when(F.abs(value) == infinite, F.lit(1.0)).otherwise(F.abs(value))
    size = F.when(F.abs(value) == infinite, F.lit(2 * _SHIFT)).otherwise(F.floor(F.log2(finite) * RESOLUTION) + _SHIFT)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """One row per group: ``keys``, ``n`` and a column per name in ``probs``.

    Linear interpolation between the two ranks around ``p * (n - 1)``; nulls and NaN are ignored, an
    infinity is the lowest or highest value (between it and another value lies an infinity), and a group without values gives no row. Without keys there is always one row.
    """
    keys = keys or []
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.withColumn("_b", _bucket(F.col("_v")))

    counted = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    # Windows over bucket counts only: their size depends on the value range, not on the rows.
    in_order = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counted.select(
        *keys, "_b",
        (F.sum("_c").over(in_order) - F.col("_c")).alias("_before"),
        F.col("_c"),
        F.sum("_c").over(W.partitionBy(*keys)).alias("n"),
    )
    wanted = []
    for i, p in enumerate(probs.values()):
        position = F.lit(float(p)) * (F.col("n") - 1)
        wanted += [
            F.struct(F.lit(2 * i).alias("slot"), F.floor(position).alias("rank")),
            F.struct(F.lit(2 * i + 1).alias("slot"), F.ceil(position).alias("rank")),
        ]
    before, count = F.col("_before"), F.col("_c")
    hits = F.filter(F.array(*wanted), lambda w: (w["rank"] >= before) & (w["rank"] < before + count))
    targets = placed.select(*keys, "_b", "_before", "n", hits.alias("_hits")).filter(F.size("_hits") > 0)

    if keys:
        targets = broadcast_if_small(targets)
    else:
        # At most two rows per probability.
        targets = F.broadcast(targets)

    values = (
        rows.join(targets, [*keys, "_b"])
        .groupBy(*keys, "_b", "_v")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_before").alias("_before"),
             F.first("n").alias("n"), F.first("_hits").alias("_hits"))
    )
    by_value = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.col("_before") + F.sum("_c").over(by_value)
    found = (
        values.withColumn("_upto", upto)
        .withColumn("_hit", F.explode("_hits"))
        .filter((F.col("_hit.rank") < F.col("_upto")) & (F.col("_hit.rank") >= F.col("_upto") - F.col("_c")))
    )
    slots = found.groupBy(*keys).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("_hit.slot") == s, F.col("_v"))).alias(f"_s{s}") for s in range(2 * len(probs))],
    )
    out = [F.col(k) for k in keys] + [F.col("n")]
    for i, (name, p) in enumerate(probs.items()):
        position = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        share = position - F.floor(position)
        out.append(F.when((low == high) | (share == 0), low).otherwise(low + (high - low) * share).alias(name))
    return slots.select(*out)
