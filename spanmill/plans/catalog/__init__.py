"""Every operator as a named query over the given tables, with its SQL counterpart.

Keys are the operator names of the blueprint. ``queries()`` and ``oracles()`` are what
the entry module hands out.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from spanmill.plans.catalog.registry import ORACLES, QUERIES

_SECTIONS = ("io", "scalars", "filters", "joins", "aggregates", "rollup", "score", "privacy", "drifting", "alerting", "streams", "checks")


def _load() -> None:
    for section in _SECTIONS:
        import_module(f"spanmill.plans.catalog.{section}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
