"""From an incident to its first detection and first alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_WAIT_SECONDS = 300


def first_at_or_after(
    starts: DataFrame, hits: DataFrame, key: str, start_ts: str, hit_ts: str, out: str, bucket_seconds: int = 60
) -> DataFrame:
    """Each row of ``starts`` with the earliest hit of its key at or after its start.

    An as-of lookup without pairs: time is cut into buckets. A hit in the start's own
    bucket comes from a window over (key, bucket); failing that, the first hit of the
    next bucket that has one comes from a window over one row per bucket. A busy key is
    spread over its buckets, and repeated hit times are merged first.
    """
    def bucket(ts: str) -> Column:
        return F.floor(F.unix_micros(ts) / (bucket_seconds * 1_000_000)).cast("long")

    times_hit = hits.filter(F.col(hit_ts).isNotNull()).select(key, F.col(hit_ts).alias("_hit")).distinct()
    times_hit = times_hit.withColumn("_b", bucket("_hit"))
    begun = starts.withColumn("_b", bucket(start_ts))

    row = F.struct(*[F.col(c) for c in starts.columns])
    merged = begun.select(key, "_b", F.col(start_ts).alias("_at"), F.lit(None).cast("timestamp").alias("_hit"), row.alias("_row")).unionByName(
        times_hit.select(key, "_b", F.col("_hit").alias("_at"), "_hit"), allowMissingColumns=True
    )
    # Latest first, peers included: the running minimum is the earliest hit not before the row.
    later = W.partitionBy(key, "_b").orderBy(F.col("_at").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    own = merged.withColumn("_own", F.min("_hit").over(later)).filter(F.col("_row").isNotNull())

    per_bucket = times_hit.groupBy(key, "_b").agg(F.min("_hit").alias("_first")).unionByName(
        begun.select(key, "_b").distinct(), allowMissingColumns=True
    ).groupBy(key, "_b").agg(F.min("_first").alias("_first"))
    after = W.partitionBy(key).orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)
    following = per_bucket.withColumn("_next", F.min("_first").over(after)).select(key, "_b", "_next")

    return (
        own.join(following, [key, "_b"], "left")
        .select("_row.*", F.coalesce("_own", "_next").alias(out))
    )


def _seconds(later: str, earlier: str) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000.0


def detection_latency(incidents: DataFrame, detections: DataFrame, key: str = "scope") -> DataFrame:
    """Seconds from ``injected_at`` to the first detection; null where there is none.

    ``incidents`` has (incident_id, key, injected_at), ``detections`` (key, detected_at).
    """
    found = first_at_or_after(incidents, detections, key, "injected_at", "detected_at", "first_detected_at")
    return found.withColumn("detect_seconds", _seconds("first_detected_at", "injected_at"))


def regression_report(
    incidents: DataFrame, detections: DataFrame, alerts: DataFrame, key: str = "scope",
    limit_seconds: int = MAX_WAIT_SECONDS,
) -> DataFrame:
    """Detect and alert latency per incident; passed only with a detection inside the limit.

    ``alerts`` has (key, fired_at).
    """
    detected = detection_latency(incidents, detections, key)
    alerted = first_at_or_after(detected, alerts, key, "injected_at", "fired_at", "first_alert_at")
    in_time = F.col("detect_seconds") < limit_seconds
    return alerted.withColumn("alert_seconds", _seconds("first_alert_at", "injected_at")).withColumn(
        "passed", F.coalesce(in_time, F.lit(False))
    )
