"""Personal-data scan of responses. Map-only: the same code runs on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.functions import pii, times
from spanmill.functions.labels import short


def scan(df: DataFrame, text: str = "response", cards: bool = False) -> DataFrame:
    """Adds items, detected, score and reason."""
    items = F.col("pii_items")
    return df.withColumn("pii_items", pii.pii_items(text, cards)).withColumns({
        "pii_detected": F.size(items) > 0,
        "pii_score": pii.pii_score(items),
        "pii_reason": pii.pii_reason(items),
    })


def triage(
    df: DataFrame, as_of, text: str = "response", threshold: float = pii.THRESHOLD,
    always_flag: tuple[str, ...] = (), cards: bool = False, max_chars: int | None = None,
) -> DataFrame:
    """Queue rows of the responses that need a look, with the whole text or its first ``max_chars``."""
    items = F.col("pii_items")
    return (
        scan(df, text, cards)
        .filter(pii.needs_triage(items, threshold, always_flag))
        .select(
            "trace_id",
            F.col("pii_score").alias("score"),
            F.to_json(items).alias("detected_items"),
            (F.col(text) if max_chars is None else short(text, max_chars)).alias("response_text"),
            times.moment(as_of).alias("evaluated_at"),
            F.lit(False).alias("resolved"),
        )
    )


def pending(queue: DataFrame) -> DataFrame:
    """Unresolved queue rows, highest score first."""
    return queue.filter(~F.col("resolved")).orderBy(F.col("score").desc(), "evaluated_at", "trace_id")


def flagged_rate(df: DataFrame, ts: str, text: str = "response", threshold: float = pii.THRESHOLD) -> DataFrame:
    """Share of detected and of flagged responses per hour and model."""
    scanned = scan(df, text)
    flagged = pii.needs_triage(F.col("pii_items"), threshold)
    return scanned.groupBy(times.hour_of(ts).alias("hour"), "model").agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if("pii_detected").alias("detected"),
        F.count_if(flagged).alias("flagged"),
        F.avg(flagged.cast("double")).alias("flagged_rate"),
    )


def redact(df: DataFrame, text: str = "response", out: str | None = None, cards: bool = False, mask: str = "*") -> DataFrame:
    """``df`` with personal data in ``text`` masked in place, in ``out`` if given; and ``pii_runs``, the number of masked runs.

    Matches of different patterns may overlap; every maximal run of matched characters is masked as one, character by
    character, so all other positions stay where they were. Whole texts, of any length; a null text stays null with 0
    runs. ``mask`` is one character. Nothing is shuffled, and texts without a match are passed on as they are.
    """
    if len(mask) != 1:
        raise ValueError("mask must be one character")
    words = F.when(pii.has_pii(text, cards), pii.masked_words(text, cards, mask))
    # In a column of their own: they are used for the text and for the count.
    found = df.withColumn("_words", words)
    clean = F.when(F.col("_words").isNotNull(), F.array_join("_words.text", "")).otherwise(F.col(text))
    runs = F.aggregate(F.coalesce("_words.runs", F.array().cast("array<int>")), F.lit(0), lambda sum_, n: sum_ + n)
    return found.withColumns({out or text: clean, "pii_runs": runs}).drop("_words")
