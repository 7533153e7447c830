"""Adaptive context-mixing range coder for token ids, many independent blocks at a time.

Every block starts anew: empty tables, first range. The next id is predicted from the two ids before it (order 2) and
from the one before it (order 1); each prediction has a confidence, and each confidence a learned chance of being
right. The two chances are mixed with weights that follow which order was right when they disagreed, which gives the
probabilities of three cases: order 2 right, order 1 right, neither. In the last case the id itself follows: its upper
part by adaptive counts (order 0), its lower eight bits evenly.

All arithmetic is on integers, so a block decodes to the same ids anywhere. Blocks are coded in step, one id of each
at a time, as numpy arrays over the blocks; there is no loop over single ids.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 4096
_CONTEXT_BITS = 10
_STATE, _LOW_BITS = np.uint64((1 << 48) - 1), np.uint64((1 << 24) - 1)
_SMALL = np.uint64(1 << 24)
_CASE_BITS, _UPPER_BITS = 12, 12
#: After so many ids the order-0 counts become a new table.
_REFRESH = 64


class BrokenBlock(ValueError):
    """A block whose checksum does not fit its ids."""


#: Where the chances of a guess start, by confidence; they move towards what is seen, within (_LEAST, _MOST) of 4096.
_START = np.array([200, 1000, 1800, 2400, 2800, 3100, 3300, 3500], np.int32)
_LEAST, _MOST = 60, 3900


class _Order:
    """The guesses of one order: by block and context a guessed id and its confidence (0 to 7), packed as id * 8 + confidence."""

    def __init__(self, n: int):
        self.table = np.zeros(n << _CONTEXT_BITS, np.uint32)
        self.chances = np.tile(_START, n)
        self.rows = np.arange(n, dtype=np.int64) << _CONTEXT_BITS
        self.eights = np.arange(n, dtype=np.int64) << 3

    def look(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Guesses and their chances (of 4096) under 32-bit hashed contexts."""
        k = len(context)
        self.at = self.rows[:k] + (context >> np.uint32(32 - _CONTEXT_BITS))
        self.entry = self.table.take(self.at)
        self.sure = self.entry & np.uint32(7)
        self.chance_at = self.eights[:k] + self.sure
        self.chance = self.chances.take(self.chance_at)
        return self.entry >> np.uint32(3), self.chance

    def learn(self, hit: np.ndarray, ids: np.ndarray) -> None:
        move = np.where(hit, _MOST, _LEAST)
        move -= self.chance
        move >>= 5
        move += self.chance
        self.chances[self.chance_at] = move
        # Confidence rises by one with a hit and halves without; a guess without any gives way.
        kept = self.entry - (self.sure - (self.sure >> np.uint32(1)))
        kept = np.where(self.sure == 0, ids << np.uint32(3), kept)
        self.table[self.at] = np.where(hit, self.entry + (self.sure < 7), kept)


class _Model:
    """Tables of ``n`` blocks; every method works on the first ``k`` of them."""

    def __init__(self, n: int, uppers: int):
        self.two, self.one = _Order(n), _Order(n)
        self.weight = np.full(n, 2048, np.int32)
        self.last1, self.last2 = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.counts = np.full((n, uppers), 2, np.int32)
        self.refresh(n)

    def refresh(self, k: int) -> None:
        """Order-0 frequencies of the upper parts, at least 1 each, 2 ** _UPPER_BITS in total."""
        counts = self.counts[:k]
        width = counts.shape[1]
        total = counts.sum(1, keepdims=True)
        frequencies = 1 + counts * ((1 << _UPPER_BITS) - width) // total
        frequencies[:, 0] += (1 << _UPPER_BITS) - frequencies.sum(1)
        ends = np.zeros((k, width + 1), np.int32)
        np.cumsum(frequencies, axis=1, out=ends[:, 1:])
        self.ends, self.width = ends.ravel(), width
        full = np.flatnonzero(total.ravel() > 4096)
        counts[full] = np.maximum(counts[full] >> 1, 1)

    def predict(self, k: int) -> tuple[np.ndarray, ...]:
        """The guesses of order 2 and 1, and the frequencies of their cases (of 2 ** _CASE_BITS)."""
        last = self.last1[:k]
        guess1, chance1 = self.one.look(last * np.uint32(2654435761))
        guess2, chance2 = self.two.look((last * np.uint32(2246822519)) ^ (self.last2[:k] * np.uint32(3266489917)))
        weight = self.weight[:k]
        agree = guess2 == guess1
        share1 = ((4096 - weight) * chance1) >> 12
        case2 = ((weight * chance2) >> 12) + share1 * agree + 1
        case1 = share1 * ~agree + 1
        return guess2, guess1, case2, case1

    def update(self, k: int, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        self.two.learn(hit2, ids)
        self.one.learn(hit1, ids)
        weight = self.weight[:k]
        apart = hit2 != hit1
        aim = np.where(hit2, 4000, 96)
        weight += ((aim - weight) >> 5) * apart
        self.last2[:k] = self.last1[:k]
        self.last1[:k] = ids


def _active(lengths: np.ndarray, steps: int) -> np.ndarray:
    """How many blocks have an id at each step; lengths descend."""
    return np.searchsorted(-lengths, -np.arange(steps), "left")


def encode_blocks(blocks: list[np.ndarray], limit: int) -> list[bytes]:
    """The coded form of each block of ids below ``limit``."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    n, steps = len(blocks), int(lengths[0])
    ids = np.zeros((steps, n), np.uint32)
    for lane, i in enumerate(order):
        ids[: len(blocks[i]), lane] = blocks[i]
    model = _Model(n, (limit >> 8) + 1)
    low, width = np.zeros(n, np.uint64), np.full(n, _STATE, np.uint64)
    out, used = np.zeros((n, 3 * steps + 16), "<u2"), np.zeros(n, np.int64)

    def narrow(lanes, begin: np.ndarray, size: np.ndarray, bits: int) -> None:
        part = width[lanes] >> np.uint64(bits)
        low_, width_ = low[lanes] + begin.astype(np.uint64) * part, size.astype(np.uint64) * part
        while True:
            settled = (low_ ^ (low_ + width_)) >> np.uint64(32) == 0
            ready = np.flatnonzero(settled | (width_ < _SMALL))
            if not len(ready):
                break
            at = low_[ready]
            wide = np.where(settled[ready], width_[ready], (~at + np.uint64(1)) & _LOW_BITS)
            lane = ready if isinstance(lanes, slice) else lanes[ready]
            out[lane, used[lane]] = at >> np.uint64(32)
            used[lane] += 1
            low_[ready] = (at << np.uint64(16)) & _STATE
            width_[ready] = wide << np.uint64(16)
        low[lanes], width[lanes] = low_, width_

    for step, k in enumerate(_active(lengths, steps).tolist()):
        now = ids[step, :k]
        guess2, guess1, case2, case1 = model.predict(k)
        hit2, hit1 = now == guess2, now == guess1
        first = case2 + case1
        begin = np.where(hit2, 0, np.where(hit1, case2, first))
        size = np.where(hit2, case2, np.where(hit1, case1, (1 << _CASE_BITS) - first))
        narrow(slice(0, k), begin, size, _CASE_BITS)
        new = np.flatnonzero(~hit2 & ~hit1)
        if len(new):
            own = now[new]
            upper, lower = (own >> np.uint32(8)).astype(np.int64), (own & np.uint32(255)).astype(np.int64)
            place = new * (model.width + 1) + upper
            start = model.ends.take(place).astype(np.int64)
            size = model.ends.take(place + 1) - start
            narrow(new, (start << 8) + lower * size, size, _UPPER_BITS + 8)
            model.counts[new, upper] += 16
        model.update(k, now, hit2, hit1)
        if step % _REFRESH == _REFRESH - 1:
            model.refresh(k)
    for shift in (32, 16, 0):
        out[np.arange(n), used] = (low >> np.uint64(shift)) & np.uint64(0xFFFF)
        used += 1
    coded: list[bytes] = [b""] * n
    for lane, i in enumerate(order):
        head = np.array([len(blocks[i]), zlib.crc32(blocks[i].astype("<u4").tobytes())], "<u4").tobytes()
        coded[i] = head + out[lane, : used[lane]].tobytes()
    return coded


def decode_blocks(coded: list[bytes], limit: int) -> list[np.ndarray]:
    """The ids of coded blocks; ``BrokenBlock`` if a checksum does not fit."""
    if not coded:
        return []
    sizes = np.array([int.from_bytes(c[:4], "little") for c in coded])
    if sizes.max(initial=0) > 1 << 24 or min(map(len, coded)) < 14:
        raise BrokenBlock("a block has no valid head")
    order = np.argsort(-sizes, kind="stable")
    lengths = sizes[order]
    n, steps = len(coded), int(lengths[0])
    words = [np.frombuffer(coded[i][8 : len(coded[i]) // 2 * 2], "<u2") for i in order]
    source = np.zeros((n, max(map(len, words)) + 2 * steps + 8 if steps < 64 else max(map(len, words)) + 8), np.uint64)
    for lane, own in enumerate(words):
        source[lane, : len(own)] = own
    rows, last = np.arange(n), source.shape[1] - 1
    ids = np.zeros((steps, n), np.uint32)
    model = _Model(n, (limit >> 8) + 1)
    low, width, used = np.zeros(n, np.uint64), np.full(n, _STATE, np.uint64), np.full(n, 3)
    value = source[:, 0] << np.uint64(32) | source[:, 1] << np.uint64(16) | source[:, 2]

    def find(lanes, bits: int) -> tuple[np.ndarray, np.ndarray]:
        part = width[lanes] >> np.uint64(bits)
        return np.minimum((value[lanes] - low[lanes]) // part, np.uint64((1 << bits) - 1)).astype(np.int64), part

    def narrow(lanes, part: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        low_, width_, value_ = low[lanes] + begin.astype(np.uint64) * part, size.astype(np.uint64) * part, value[lanes].copy()
        while True:
            settled = (low_ ^ (low_ + width_)) >> np.uint64(32) == 0
            ready = np.flatnonzero(settled | (width_ < _SMALL))
            if not len(ready):
                break
            at = low_[ready]
            wide = np.where(settled[ready], width_[ready], (~at + np.uint64(1)) & _LOW_BITS)
            lane = ready if isinstance(lanes, slice) else lanes[ready]
            value_[ready] = ((value_[ready] << np.uint64(16)) & _STATE) | source[lane, np.minimum(used[lane], last)]
            used[lane] += 1
            low_[ready] = (at << np.uint64(16)) & _STATE
            width_[ready] = wide << np.uint64(16)
        low[lanes], width[lanes], value[lanes] = low_, width_, value_

    for step, k in enumerate(_active(lengths, steps).tolist()):
        guess2, guess1, case2, case1 = model.predict(k)
        here = slice(0, k)
        target, part = find(here, _CASE_BITS)
        hit2 = target < case2
        hit1 = ~hit2 & (target < case2 + case1)
        begin = np.where(hit2, 0, np.where(hit1, case2, case2 + case1))
        size = np.where(hit2, case2, np.where(hit1, case1, (1 << _CASE_BITS) - case2 - case1))
        narrow(here, part, begin, size)
        now = np.where(hit2, guess2, guess1)
        new = np.flatnonzero(~hit2 & ~hit1)
        if len(new):
            target, part = find(new, _UPPER_BITS + 8)
            # The last end that is not above what is sought, found bit by bit.
            sought, row, upper = target >> 8, new * (model.width + 1), np.zeros(len(new), np.int64)
            for bit in range(model.width.bit_length() - 1, -1, -1):
                trial = upper + (1 << bit)
                fits = trial < model.width
                fits &= model.ends.take(row + np.where(fits, trial, 0)) <= sought
                upper += fits.astype(np.int64) << bit
            start = model.ends.take(row + upper).astype(np.int64)
            size = model.ends.take(row + upper + 1) - start
            lower = np.minimum((target - (start << 8)) // size, 255)
            narrow(new, part, (start << 8) + lower * size, size)
            model.counts[new, upper] += 16
            now[new] = (upper << 8 | lower).astype(np.uint32)
        ids[step, :k] = now
        # A coded guess can be an id of the other order too.
        model.update(k, now, now == guess2, now == guess1)
        if step % _REFRESH == _REFRESH - 1:
            model.refresh(k)
    found: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    for lane, i in enumerate(order.tolist()):
        own = np.ascontiguousarray(ids[: lengths[lane], lane])
        if zlib.crc32(own.astype("<u4").tobytes()) != int.from_bytes(coded[i][4:8], "little"):
            raise BrokenBlock(f"block {i} does not have its checksum")
        found[i] = own
    return found
