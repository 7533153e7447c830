"""Runs a catalogue query and its SQL, and compares the results by value."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (datetime, date, bool, str, int)) or value is None:
        return value
    return str(value)


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    result = con.execute(sql)
    expected_columns = [d[0] for d in result.description]
    expected = _rows(expected_columns, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}; first {got[:1]} vs {expected[:1]}"
    bad = [(g, e) for g, e in zip(got, expected) if g != e]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ: {bad[0][0]} != {bad[0][1]}"
    wrong = [
        (n, type(a).__name__, type(b).__name__)
        for n, a, b in zip(sorted(df.columns), got[0] if got else (), expected[0] if expected else ())
        if type(a) is not type(b)
    ]
    return f"types differ: {wrong}" if wrong else None
