"""Token sets and sentences for the lexical scorers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{L}\p{N}]+"
SENTENCE_BREAK = r"[.!?\n]+"


def _col(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def tokens(text: str | Column) -> Column:
    """Lower-cased words in order, repeats kept."""
    words = F.split(F.lower(F.coalesce(_col(text), F.lit(""))), WORD_BREAK)
    return F.array_remove(words, "")


def token_set(text: str | Column) -> Column:
    return F.array_distinct(tokens(text))


def sentences(text: str | Column) -> Column:
    """Parts between sentence marks and line ends that hold at least one word."""
    parts = F.split(F.coalesce(_col(text), F.lit("")), SENTENCE_BREAK)
    return F.filter(parts, lambda s: s.rlike(r"[\p{L}\p{N}]"))


def overlap(a: Column, b: Column) -> Column:
    """Number of distinct words two token sets share."""
    return F.size(F.array_intersect(a, b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression named twice, or named inside a lambda over an array, is computed each
    time; bound as a lambda variable it is not.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, null over nothing."""
    return F.when(whole > 0, part / whole)
