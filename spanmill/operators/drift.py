"""Embedding drift: histograms per dimension, PSI and KL divergence, trend reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions import labels, times
from spanmill.functions.text import tokens
from spanmill.operators import histograms
from spanmill.operators.latest import latest_date_only

DIMENSIONS = 384
BINS = 10
DENSITY_FLOOR = 1e-6
MIN_CURRENT = 10
CURRENT_DAYS = 7
BASELINE_DAYS = 28
#: Texts whose vectors are counted at a time.
EMBED_PIECE = 500


# ---- embeddings ----

def token_slots(text: str, dims: int = DIMENSIONS) -> Column:
    """The vector position of every word: the first 32 bits of its md5, modulo ``dims``."""
    def slot(word: Column) -> Column:
        return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % dims).cast("int")

    return F.transform(tokens(text), slot)


def embed_text(df: DataFrame, text: str, out: str = "embedding", dims: int = DIMENSIONS) -> DataFrame:
    """Hashed word counts of unit length (all zero for a text without words).

    Words are cut and hashed in Catalyst; only the counting of slots runs in Python, over
    pieces of Arrow batches, so a task holds few vectors at a time. Nothing is shuffled,
    unlike counting by (row, slot) groups.
    """

    piece = EMBED_PIECE

    def unit_counts(slots: pa.Array) -> pa.Array:
        offsets = slots.offsets.to_numpy()
        held = slots.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(slots)), np.diff(offsets))
        found = np.bincount(owner * dims + held, minlength=len(slots) * dims).astype(np.float64).reshape(len(slots), dims)
        norm = np.sqrt((found * found).sum(axis=1, keepdims=True))
        np.divide(found, norm, out=found, where=norm > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(slots) + 1) * dims, pa.int32()), pa.array(found.astype(np.float32).ravel()))

    @F.arrow_udf("array<float>")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for slots in batches:
            for at in range(0, len(slots), piece):
                yield unit_counts(slots.slice(at, piece))

    return df.withColumn(out, counts(token_slots(text, dims)))


def embed_with(df: DataFrame, text: str, make, out: str = "embedding") -> DataFrame:
    """Embeddings from a model: ``make`` loads it once per task, and returns a function
    from a list of texts to a list of vectors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for texts in batches:
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in encode(texts.tolist())])

    return df.withColumn(out, run(F.col(text)))


# ---- histograms ----

def period_of(ts: str, as_of) -> Column:
    """``current`` for the last 7 days, ``baseline`` for the 4 weeks before, else null."""
    end = times.moment(as_of)
    current_from = end - times.interval(days=CURRENT_DAYS)
    baseline_from = end - times.interval(days=CURRENT_DAYS + BASELINE_DAYS)
    ts = F.col(ts)
    return F.when((ts >= current_from) & (ts < end), "current").when(
        (ts >= baseline_from) & (ts < current_from), "baseline"
    )


def baseline_current_split(df: DataFrame, ts: str, as_of) -> DataFrame:
    """Rows of the two periods, marked by ``side``."""
    return df.withColumn("side", period_of(ts, as_of)).filter(F.col("side").isNotNull())


def histogram_by_dim(
    vectors: DataFrame, vector: str = "embedding", side: str = "side", group: list[str] | None = None, bins: int = BINS
) -> DataFrame:
    """Counts per (group, dimension, bin) and side over the joint range of both sides, for the bins that have any.

    Equal bins, the last one closed. Vectors are counted into arrays (see ``histograms``), never a row for each entry.
    """
    group = group or []
    counts = histograms.dim_counts(vectors, vector, side, group, bins)
    unfolded = counts.select(*group, "dim", "range_width", F.posexplode(F.arrays_zip("baseline", "current")).alias("bin", "_n"))
    found = unfolded.select(
        *group, "dim", "bin", F.col("_n.baseline").alias("baseline_count"), F.col("_n.current").alias("current_count"), "range_width"
    )
    return found.filter(F.col("baseline_count") + F.col("current_count") > 0)


def densities(histogram: DataFrame, group: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """Per (group, dimension): row counts and the two normalised densities as arrays, from histogram rows."""
    group = group or []
    folded = histogram.groupBy(*group, "dim").agg(
        F.map_from_entries(
            F.collect_list(F.struct("bin", F.struct("baseline_count", "current_count")))
        ).alias("_bins"),
        F.max("range_width").alias("range_width"),
    )

    def counts(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("_bins", i)[name], F.lit(0)))

    arrays = folded.select(
        *group, "dim", "range_width", counts("baseline_count").alias("baseline"), counts("current_count").alias("current")
    )
    return densities_of(arrays, group, bins)


def densities_of(counts: DataFrame, group: list[str], bins: int = BINS) -> DataFrame:
    """Densities from count arrays.

    Densities are raised to the floor, then scaled to sum 1. The floor acts on densities, so its weight depends on the
    width of the bins.
    """

    def total(name: str) -> Column:
        return F.aggregate(name, F.lit(0).cast("long"), lambda sum_, n: sum_ + n)

    def raised(name: str, rows: str) -> Column:
        return F.transform(name, lambda n: F.greatest(
            F.try_divide(n.cast("double"), F.col(rows) * F.col("range_width") / bins), F.lit(DENSITY_FLOOR)))

    counted = counts.withColumns({"n_baseline": total("baseline"), "n_current": total("current")})
    # Scaled in a second step, on the materialised arrays.
    raw = counted.withColumns({"_b": raised("baseline", "n_baseline"), "_c": raised("current", "n_current")})

    def scaled(name: str) -> Column:
        total = F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
        return F.transform(name, lambda x: x / total)

    return raw.select(
        *group, "dim", "n_baseline", "n_current", "range_width",
        scaled("_b").alias("baseline"), scaled("_c").alias("current"),
    )


def density_rows(dens: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One row per bin of the two densities."""
    pairs = F.arrays_zip("baseline", "current")
    return dens.select(
        *(group or []), "dim", "n_baseline", "n_current", F.posexplode(pairs).alias("bin", "_p")
    ).select(
        *(group or []), "dim", "bin", "n_baseline", "n_current",
        F.col("_p.baseline").alias("baseline_density"), F.col("_p.current").alias("current_density"),
    )


def _sum_over(pairs: Column, term) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + term(p["baseline"], p["current"]))


def dimension_scores(dens: DataFrame, group: list[str] | None = None) -> DataFrame:
    """PSI and KL divergence (baseline first, never below 0) per dimension.

    A constant dimension scores 0; a dimension without rows on one side scores null.
    """
    pairs = F.arrays_zip("baseline", "current")
    psi = _sum_over(pairs, lambda b, c: (c - b) * F.ln(c / b))
    kl = F.greatest(_sum_over(pairs, lambda b, c: b * F.ln(b / c)), F.lit(0.0))

    def guarded(score: Column) -> Column:
        return (
            F.when((F.col("n_baseline") == 0) | (F.col("n_current") == 0), F.lit(None))
            .when(F.col("range_width") == 0, F.lit(0.0))
            .otherwise(score)
        )

    return dens.select(
        *(group or []), "dim", "n_baseline", "n_current", guarded(psi).alias("psi"), guarded(kl).alias("kl_divergence")
    )


def drift_by_dimension(
    vectors: DataFrame, vector: str = "embedding", side: str = "side", group: list[str] | None = None, bins: int = BINS
) -> DataFrame:
    """Scores per (group, dimension), from arrays of counts."""
    group = group or []
    return dimension_scores(densities_of(histograms.dim_counts(vectors, vector, side, group, bins), group, bins), group)


def psi(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Mean and highest PSI over the dimensions, with the row counts behind it."""
    return scores.groupBy(*(group or [])).agg(
        F.avg("psi").alias("psi"), F.max("psi").alias("max_psi"),
        F.max("n_baseline").alias("n_baseline"), F.max("n_current").alias("n_current"),
    )


def kl_divergence(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    return scores.groupBy(*(group or [])).agg(F.avg("kl_divergence").alias("kl_divergence"))


def drift_by_app(vectors: DataFrame, app: str = "app_id", vector: str = "embedding", side: str = "side", min_current: int = MIN_CURRENT) -> DataFrame:
    """Mean and highest PSI and mean KL divergence of every app, with the row counts behind it and whether they are enough.

    Each app is compared with its own baseline over its own ranges. An app with rows on one side only has null scores.
    """
    scores = drift_by_dimension(vectors, vector, side, [app])
    both = scores.groupBy(app).agg(
        F.avg("psi").alias("psi"), F.max("psi").alias("max_psi"), F.avg("kl_divergence").alias("kl_divergence"),
        F.max("n_baseline").alias("n_baseline"), F.max("n_current").alias("n_current"),
    )
    return both.withColumn("enough", (F.col("n_current") >= min_current) & (F.col("n_baseline") > 0))


def score_rows(scores: DataFrame, as_of, min_current: int = MIN_CURRENT) -> DataFrame:
    """Rows of the drift table, one per (date, metric, dimension), with the number of current rows
    and whether they are enough for the score to mean something; reports read those only."""
    end = times.moment(as_of)
    split = end - times.interval(days=CURRENT_DAYS)
    start = split - times.interval(days=BASELINE_DAYS)

    def period(a: Column, b: Column) -> Column:
        return F.concat(times.format_date(a), F.lit(" to "), times.format_date(F.date_sub(b, 1)))

    both = F.array(
        F.struct(F.lit("psi").alias("metric_type"), F.col("psi").alias("score")),
        F.struct(F.lit("kl_divergence").alias("metric_type"), F.col("kl_divergence").alias("score")),
    )
    return (
        scores.select(
            F.to_date(end).alias("score_date"), F.col("dim").alias("dimension_index"), "n_current",
            ((F.col("n_current") >= min_current) & (F.col("n_baseline") > 0)).alias("enough"), F.inline(both),
        )
        .withColumns({"baseline_period": period(start, split), "current_period": period(split, end)})
    )


# ---- reports over the drift table ----

def _telling(drift_scores: DataFrame) -> DataFrame:
    """Scores of enough rows; tables without the flag hold no others."""
    return drift_scores.filter(F.coalesce("enough", F.lit(True))) if "enough" in drift_scores.columns else drift_scores


def _psi_rows(drift_scores: DataFrame, as_of, width: dict) -> DataFrame:
    day = F.col("score_date").cast("timestamp")
    return _telling(drift_scores).filter(
        (F.col("metric_type") == "psi") & times.within(day, as_of, **(width or {"days": 90}))
    )


def psi_trend(drift_scores: DataFrame, as_of, **width: int) -> DataFrame:
    """Average and highest PSI per date over the last 90 days."""
    return (
        _psi_rows(drift_scores, as_of, width)
        .groupBy("score_date", "metric_type")
        .agg(F.avg("score").alias("avg_score"), F.max("score").alias("max_score"))
        .orderBy("score_date")
        .select(times.format_date("score_date").alias("date"), "metric_type", "avg_score", "max_score")
    )


def drift_events(drift_scores: DataFrame, as_of, threshold: float = labels.PSI_WARNING, **width: int) -> DataFrame:
    """Dates whose average PSI is over the threshold, newest first, with their level."""
    return (
        _psi_rows(drift_scores, as_of, width)
        .groupBy("score_date").agg(F.avg("score").alias("psi_value"))
        .filter(F.col("psi_value") > threshold)
        .orderBy(F.col("score_date").desc())
        .select(
            times.format_date("score_date").alias("date"), "psi_value",
            labels.psi_level(F.col("psi_value")).alias("alert_level"),
        )
    )


def latest_psi(drift_scores: DataFrame) -> DataFrame:
    """Average PSI of the newest date."""
    newest = latest_date_only(_telling(drift_scores).filter(F.col("metric_type") == "psi"), "score_date")
    return newest.agg(
        F.avg("score").alias("score"), times.format_date(F.max("score_date")).alias("date")
    )
