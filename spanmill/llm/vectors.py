"""Embedding columns as numpy matrices, and exact sums over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the lists with exactly ``dims`` entries, all finite, and those lists as doubles."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.filter(fits).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(values).all(axis=1)
    return rows[finite], values[finite]


def lengths(column: pa.Array) -> list[int]:
    """The different lengths of the lists of ``column``, empty ones left out."""
    return sorted(n for n in pc.unique(pc.list_value_length(column)).to_pylist() if n)


def exact_sums(parts: DataFrame, keys: list[str], column: str = "sums") -> DataFrame:
    """(keys, dim, total) of partial sums ``column`` (arrays of long), added up as decimals, which cannot overflow."""
    return parts.select(*keys, F.posexplode(column).alias("dim", "part")).groupBy(*keys, "dim").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))
