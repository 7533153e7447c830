"""Attach one row per key to many rows, when some keys hold a large share of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key above this share of all rows is hot, so there are at most 1/share hot keys.
HOT_SHARE = 1e-5
HOT_FLOOR = 100_000


def join_per_key(
    rows: DataFrame, per_key: DataFrame, keys: list[str], spread_on: str,
    count_col: str = "key_rows", how: str = "left", match: Column | None = None,
    hot_floor: int = HOT_FLOOR,
) -> DataFrame:
    """``rows`` joined with ``per_key``, which is unique on ``keys`` and counts their rows.

    Rows of a hot key are spread over several partitions by the hash of ``spread_on``,
    and its one right row is repeated for each of them; other keys keep salt 0. The hot
    keys are broadcast: there are fewer than ``1 / HOT_SHARE`` of them. (Spark's own skew
    join does not apply where the right side comes straight from an aggregation.)
    ``per_key`` must cover all keys of ``rows``; ``match`` then says which of them join.
    """
    bound = per_key.agg(
        F.greatest(F.sum(count_col) * HOT_SHARE, F.lit(float(hot_floor))).alias("bound")
    ).scalar()
    splits = F.ceil(F.col(count_col) / bound).cast("int")
    sized = per_key.withColumn("_splits", F.greatest(splits, F.lit(1)))
    hot = sized.filter(F.col("_splits") > 1).select(*keys, "_splits")
    salted = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "_salt",
            F.when(F.col("_splits").isNotNull(), F.pmod(F.xxhash64(spread_on), F.col("_splits")).cast("int"))
            .otherwise(F.lit(0)),
        )
        .drop("_splits")
    )
    repeated = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1)))
    if match is not None:
        repeated = repeated.filter(match)
    return salted.join(repeated.drop("_splits", count_col), [*keys, "_salt"], how).drop("_salt")
