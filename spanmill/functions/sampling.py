"""Repeatable Bernoulli sampling on a key."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORING_RATE = 0.15
PII_RATE = 0.10
RAG_RATE = 0.20
TRACE_RATE = 0.10


def hash_keep(key: str | Column, rate: float, salt: str = "") -> Column:
    """True for about ``rate`` of the keys, always the same ones.

    The first 32 bits of ``md5(salt || key)``, as lower-case hex, are compared with the
    hex form of ``rate * 2**32``; equal-length hex strings order like the numbers.
    """
    if rate >= 1:
        return F.lit(True)
    if rate <= 0:
        return F.lit(False)
    key = F.col(key) if isinstance(key, str) else key
    bound = format(math.ceil(rate * 2**32), "08x")
    return F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8) < F.lit(bound)
