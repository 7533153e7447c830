"""Vectorised words and hashes over whole Arrow text columns.

A batch of texts is one UTF-8 buffer with offsets, so words, windows and their hashes come from a few numpy
passes over the bytes. Work goes in slices of whole texts of about ``SLICE_BYTES``, which bounds memory.
Hashes are 64 bit, the same for the same bytes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, step in (("up", _STEP), ("down", _STEP_INVERSE)):
            row = np.full(size, step, np.uint64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row)
    return _POWERS["up"], _POWERS["down"]


@lru_cache
def _table(kind: str) -> tuple[np.ndarray, bool]:
    separators = np.zeros(256, bool)
    if kind == "space":
        separators[[0x20, *range(0x09, 0x0E)]] = True
    elif kind == "alnum":
        separators[:0x80] = True
        separators[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
    elif kind == "line":
        separators[0x0A] = True
    return separators, True


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Slice:
    """Whole texts: ``data`` (uint8), ``bounds`` (offsets, one more than texts), ``first`` (row of the first text)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first = data, bounds, first
        self.n = len(bounds) - 1
        self._prefix = None

    def lower(self) -> Slice:
        """A-Z in lower case, every other byte as it is."""
        return Slice(_LOWER[self.data], self.bounds, self.first)

    def spans(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the maximal runs without separators of ``kind``."""
        inside = ~_table(kind)[0][self.data]
        size = len(inside)
        if not size:
            none = np.zeros(0, np.int64)
            return none, none, none
        edge = np.zeros(size + 1, bool)
        edge[self.bounds] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        starts = np.flatnonzero(opens)
        return starts, np.flatnonzero(closes) + 1, self.text_of(starts)

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, positions, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of all lines between ``\\n``, empty ones too."""
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.concatenate([self.bounds[:-1], breaks + 1])
        ends = np.concatenate([self.bounds[1:], breaks])
        texts = np.concatenate([np.arange(self.n), self.text_of(breaks)])
        order = np.lexsort((starts, texts))
        starts, texts = starts[order], texts[order]
        ends = ends[np.lexsort((ends, np.concatenate([np.arange(self.n), self.text_of(breaks)])))]
        return starts, ends, texts

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte strings [start, end)."""
        up, down = _powers(len(self.data) + 1)
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[self.data] * up[: len(self.data)], out=self._prefix[1:])
        body = (self._prefix[ends] - self._prefix[starts]) * down[starts]
        return mix(body + (ends - starts).astype(np.uint64) * _GOLD)

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """How many of ``flags`` (one for each byte) are set in each text."""
        running = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=running[1:])
        return running[self.bounds[1:]] - running[self.bounds[:-1]]


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of an Arrow string column in slices of whole texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(bounds, bounds[begin] + size, "right")) - 1
        end = min(max(end, begin + 1), len(column))
        yield Slice(whole[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin], begin)
        begin = end


def windows(values: np.ndarray, owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and hashes of ``width`` neighbouring values with one owner."""
    if len(values) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = len(values) - width + 1
    hashed = values[:last].copy()
    for k in range(1, width):
        hashed = hashed * _STEP + values[k : k + last]
    places = np.flatnonzero(owners[:last] == owners[width - 1 :])
    return places, mix(hashed[places])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def cover(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in any of the ranges."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps)[:size] > 0
