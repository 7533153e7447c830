"""Severity levels, fixed-decimal text and short forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PSI_WARNING = 0.2
PSI_CRITICAL = 0.25


def psi_level(score: Column) -> Column:
    """Strictly above 0.25 critical, strictly above 0.2 warning, else normal."""
    return (
        F.when(score > PSI_CRITICAL, "critical")
        .when(score > PSI_WARNING, "warning")
        .otherwise("normal")
    )


def fixed(value: Column, decimals: int) -> Column:
    """Decimal text without grouping; null reads as 0."""
    return F.format_string(f"%.{decimals}f", F.coalesce(value.cast("double"), F.lit(0.0)))


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), fixed(value, 4))


def grouped(value: Column) -> Column:
    """Integer with thousands separators; null reads as 0."""
    return F.format_number(F.coalesce(value.cast("long"), F.lit(0).cast("long")), 0)


def short(text: str | Column, length: int) -> Column:
    """The first ``length`` characters, for display and queue rows."""
    return F.substring(text, 1, length)
