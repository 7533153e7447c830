"""Removal of repeated byte strings, the first occurrence staying, by longest-previous-factor arrays over anchors.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier (smaller doc_id, or the same document
and an earlier start). A document is known by doc_id and the hash of its text, so that rows may share an id; the hash
then says which of them is earlier. In terms of the longest-previous-factor array of all texts, with matches never crossing
documents: every position whose longest earlier match has ``LENGTH`` bytes or more removes that many bytes.

No task sees all suffixes. Every window of ``LENGTH`` bytes chooses an anchor by its content alone, the smallest
hashed gram of ``GRAM`` bytes in it, so equal windows choose equal grams at equal places, and only suffixes with one
anchor need to be compared:

1. Anchors, with a digest of the bytes that their windows span, are dealt by gram. Where gram and digest repeat, all
   windows of all but the first repeat; grams that stand once are done.
2. Of grams with several surroundings, the first of each surrounding is fetched from its text, and within such a group
   the suffixes are put in order, with the lengths that neighbours have in common. Previous and next smaller positions
   in that order give the longest-previous-factor array; suffixes of which it reaches ``LENGTH`` repeat. Windows of a
   gram with more than ``CROWD`` surroundings are not held together: the smallest place of each window is taken by an
   aggregation that combines before it shuffles, and met by all others of its kind, hot windows spread.
3. The removed ranges meet their text again.

Repeats within what one task reads are settled there, before anything is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.bytetext import Slice, cover, mix, ranges, slices
from spanmill.llm.jaccard import PRUNED
from spanmill.llm.tasks import Batches, in_arrow
from spanmill.operators.skew import join_per_key
from spanmill.session import counted_copy, cut_lineage, settings, work_path

LENGTH, GRAM = 100, 32
CHUNK_BYTES = 8 << 20
CROWD = 20_000
#: Suffixes sorted together.
SORTED = 200_000


def anchors(s: Slice, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor places, the first and last window start of each, and text numbers."""
    size = len(s.data)
    reach = length - gram + 1
    lengths = np.diff(s.bounds)
    windows = np.maximum(lengths - length + 1, 0)
    if not windows.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none
    places = np.arange(size - gram + 1)
    value = (s.hashes(places, places + gram) >> np.uint64(32)).astype(np.uint32)
    index = places.astype(np.int32)
    width = 1
    while width < reach:
        step = min(width, reach - width)
        left, right = value[:-step], value[step:]
        first = left <= right
        index = np.where(first, index[:-step], index[step:])
        value = np.where(first, left, right)
        width += step
    starts = ranges(s.bounds[:-1], windows)
    text = np.repeat(np.arange(s.n), windows)
    chosen = index[starts]
    head = np.ones(len(starts), bool)
    head[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(head)
    end = np.append(begin[1:], len(starts)) - 1
    return chosen[begin].astype(np.int64), starts[begin], starts[end], text[begin]


def _firsts(keys: tuple[np.ndarray, ...], docs: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by keys, then place; which rows in it are the first of their keys, and which stand at a later place."""
    order = np.lexsort((starts, hashes, docs, *keys[::-1]))
    head = np.ones(len(order), bool)
    head[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    return order, head, np.any([x[order] != x[first] for x in (docs, hashes, starts)], axis=0)


def _anchor_blocks(parts: int, length: int, gram: int):
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("block", pa.binary())])

    def deal(held: list[tuple[np.ndarray, ...]], turn: int) -> Batches:
        grams, digests, docs, hashes, starts, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order, head, later = _firsts((grams, digests), docs, hashes, starts)
        grams, digests, docs, hashes, starts, counts = (x[order] for x in (grams, digests, docs, hashes, starts, counts))
        numbers, kinds, blocks = [], [], []
        if later.any():
            numbers, kinds = [turn % parts], [1]
            blocks = [np.concatenate([docs[later], hashes[later], starts[later], starts[later] + counts[later] - 1 + length]).tobytes()]
        rows = np.stack([grams[head].view(np.int64), digests[head].view(np.int64), docs[head], hashes[head], (starts << 12 | counts)[head]])
        part = (mix(grams[head]) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((rows[4], rows[3], rows[2], part))
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            if cuts[p] < cuts[p + 1]:
                numbers.append(p)
                kinds.append(0)
                blocks.append(rows[:, order[cuts[p] : cuts[p + 1]]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(kinds, pa.int8()), pa.array(blocks, pa.binary())], schema=schema)

    def run(batches: Batches) -> Batches:
        held, size, turn = [], 0, 0
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy() for c in ("doc_id", "text_hash"))
            for s in slices(batch.column("text")):
                place, low, high, text = anchors(s, length, gram)
                grams = s.hashes(place, place + gram)
                digests = mix(s.hashes(low, high + length) ^ ((place - low) << 8 | (high - low)).astype(np.uint64))
                held.append((grams, digests, ids[s.first + text], hashes[s.first + text], low - s.bounds[text], high - low + 1))
                size += len(s.data)
                turn += 1
                if size > CHUNK_BYTES:
                    yield from deal(held, turn)
                    held, size = [], 0
        if held:
            yield from deal(held, turn)

    return run


_FOUND = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("crowd", pa.int64())])


def _rows(kind: int, key, doc, text_hash, start, stop, crowd) -> Batches:
    for at in range(0, len(doc), 1 << 16):
        piece = slice(at, at + (1 << 16))
        n = len(doc[piece])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), *(pa.nulls(n, pa.int64()) if c is None else pa.array(c[piece]) for c in (key, doc, text_hash, start, stop, crowd))],
            schema=_FOUND,
        )


def _compare_anchors(length: int):
    """Of the dealt anchors: ranges that repeat as a whole (kind 1), and surroundings to look into (kind 2)."""

    def settle(held: list[np.ndarray]) -> Batches:
        grams, digests, docs, hashes, packed = np.concatenate(held, axis=1)
        starts, counts = packed >> 12, packed & 4095
        order, head, later = _firsts((grams, digests), docs, hashes, starts)
        grams, docs, hashes, starts, counts = (x[order] for x in (grams, docs, hashes, starts, counts))
        yield from _rows(1, None, docs[later], hashes[later], starts[later], (starts + counts - 1 + length)[later], None)
        grams, docs, hashes, starts, counts = (x[head] for x in (grams, docs, hashes, starts, counts))
        begin = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        sizes = np.diff(np.append(begin, len(grams)))
        crowd = np.repeat(sizes, sizes)
        several = crowd > 1
        yield from _rows(2, *(x[several] for x in (grams, docs, hashes, starts, starts + counts - 1 + length, crowd)))

    def run(batches: Batches) -> Batches:
        part, held = None, []
        for batch in batches:
            for number, kind, block in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("block"), strict=True):
                if kind == 0:
                    if number != part and held:
                        yield from settle(held)
                        held = []
                    part = number
                    held.append(np.frombuffer(block.as_buffer(), np.int64).reshape(5, -1).copy())
                else:
                    yield from _rows(1, None, *np.frombuffer(block.as_buffer(), np.int64).reshape(4, -1), None)
        if held:
            yield from settle(held)

    return run


def _surroundings(length: int, whole: bool):
    """Texts with the ranges to fetch from them, to rows (key, doc_id, text_hash, start, bytes); unless ``whole``, window by window."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            asked = batch.column("asked")
            keys, starts, stops = (asked.flatten().field(c).to_numpy() for c in ("key", "start", "stop"))
            cuts = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(asked).to_numpy())])
            documents = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True)
            out: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for row, (doc, text_hash, text) in enumerate(documents):
                raw = (text or "").encode()
                for i in range(cuts[row], cuts[row + 1]):
                    start, stop = int(starts[i]), int(stops[i])
                    if stop > len(raw):  # another text with the same hash
                        continue
                    if whole:
                        pieces = [(int(keys[i]), start, raw[start:stop])]
                    else:
                        pieces = [(_digest(raw[p : p + length]), p, raw[p : p + length]) for p in range(start, stop - length + 1)]
                    for key, place, piece in pieces:
                        for column, value in zip(out, (key, doc, text_hash, place, piece), strict=True):
                            column.append(value)
                        size += len(piece)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)
                        out, size = ([], [], [], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return run


def _crowded_matches(windows: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, start, stop) of the windows that stand earlier too; of windows like those of ``_surroundings``."""
    windows = cut_lineage(windows)
    keys = ["key", "bytes"]
    firsts = windows.groupBy(*keys).agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("first"), F.count(F.lit(1)).alias("key_rows"))
    met = join_per_key(windows, cut_lineage(firsts), keys, "doc_id", hot_floor=5_000)
    later = met.filter(F.struct("doc_id", "text_hash", "start") != F.col("first"))
    return later.select("doc_id", "text_hash", "start", (F.col("start") + length).alias("stop"))


def _digest(window: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)


def previous_factors(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array, in suffix order.

    ``place`` tells where each suffix stands and ``common`` how many bytes it shares with the suffix before it in order
    (the first: 0). The longest earlier match of a suffix is with its previous or its next smaller position in that order,
    and is as long as the least of ``common`` on the way there. Both are found by pointer jumping over whole arrays: what lies
    between a suffix and the one it points to is never smaller, so a pointer to one that is not smaller moves to where that one points.
    """
    def towards_start(place: np.ndarray, common: np.ndarray) -> np.ndarray:
        # Slot 0 is a bound smaller than all places.
        held = np.concatenate([[np.iinfo(np.int64).min], place])
        length = np.concatenate([[0], common])
        at = np.maximum(np.arange(len(held)) - 1, 0)
        open_ = np.flatnonzero(held[at] >= held)
        open_ = open_[open_ > 0]
        while len(open_):
            over = at[open_]
            length[open_] = np.minimum(length[open_], length[over])
            at[open_] = at[over]
            open_ = open_[held[at[open_]] >= held[open_]]
        return np.where(at[1:] > 0, length[1:], 0)

    following = np.append(common[1:], 0)
    return np.maximum(towards_start(place, common), towards_start(place[::-1], following[::-1])[::-1])


def earlier_matches(data: np.ndarray, bounds: np.ndarray, docs: np.ndarray, hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes have an earlier match of ``length`` bytes, for pieces of texts.

    Piece i is data[bounds[i]:bounds[i + 1]] and stands at (docs[i], hashes[i], starts[i]); the suffixes are all of its starts
    that have ``length`` bytes, piece by piece. They are put in order by those bytes, so common prefixes count up to ``length``.
    """
    counts = np.diff(bounds) - length + 1
    at = ranges(bounds[:-1], counts)
    suffixes = np.lib.stride_tricks.sliding_window_view(data, length)[at]
    order = np.argsort(suffixes.view(f"S{length}").ravel(), kind="stable")
    ordered = suffixes[order]
    common = np.zeros(len(order), np.int64)  # with the suffix before it
    differ = ordered[1:] != ordered[:-1]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    doc, text_hash, start = np.repeat(docs, counts), np.repeat(hashes, counts), np.repeat(starts - bounds[:-1], counts) + at
    same = np.lexsort((start, text_hash, doc))
    # The same place may be held twice, by repeated rows; it is no match of its own.
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[same][1:] != x[same][:-1] for x in (doc, text_hash, start)], axis=0)
    place = np.empty(len(order), np.int64)
    place[same] = np.cumsum(new)
    earlier = np.empty(len(order), bool)
    earlier[order] = previous_factors(place[order], common) >= length
    twin = np.zeros(len(order), bool)
    twin[same[~new]] = True
    return earlier & ~twin


def _order_suffixes(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def settle(keys, docs, hashes, starts, pieces) -> Batches:
        sizes = np.array([len(p) for p in pieces])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        docs, hashes, starts = (np.array(x, np.int64) for x in (docs, hashes, starts))
        found = earlier_matches(data, bounds, docs, hashes, starts, length)
        counts = sizes - length + 1
        doc, text_hash, start = np.repeat(docs, counts)[found], np.repeat(hashes, counts)[found], (np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum()))[found]
        if len(doc):
            # Neighbouring starts become one range.
            head = np.ones(len(doc), bool)
            head[1:] = (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1]) | (start[1:] != start[:-1] + 1)
            begin = np.flatnonzero(head)
            end = np.append(begin[1:], len(doc)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(text_hash[begin]), pa.array(start[begin]), pa.array(start[end] + length)], schema=schema)

    def run(batches: Batches) -> Batches:
        held: tuple[list, ...] = ([], [], [], [], [])
        suffixes = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text_hash", "start", "bytes")), strict=True):
                if suffixes > SORTED and row[0] != held[0][-1]:
                    yield from settle(*held)
                    held, suffixes = ([], [], [], [], []), 0
                for column, value in zip(held, row, strict=True):
                    column.append(value)
                suffixes += len(row[4]) - length + 1
        if held[0]:
            yield from settle(*held)

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, start, stop): byte ranges of the texts of ``docs`` that repeat an earlier string; they may overlap."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    dealt = in_arrow(known, _anchor_blocks(4 * tasks, length, gram), "part int, kind byte, block binary")
    path = work_path(spark, "anchors")
    kinds = "kind int, key bigint, doc_id bigint, text_hash bigint, start bigint, stop bigint, crowd bigint"
    in_arrow(dealt.repartition(tasks, "part").sortWithinPartitions("part"), _compare_anchors(length), kinds).write.partitionBy("kind").parquet(path)
    found = spark.read.schema(kinds).parquet(path)
    crowded = F.col("crowd") > CROWD
    looked, _, crowds = counted_copy(found.filter("kind = 2").select("doc_id", "text_hash", "key", "start", "stop", "crowd"), crowded)

    def pieces(rows: DataFrame, whole: bool) -> DataFrame:
        asked = cut_lineage(rows.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("key", "start", "stop")).alias("asked")))
        texts = known.join(asked.filter("doc_id > -9223372036854775808"), ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "asked")
        return in_arrow(texts, _surroundings(length, whole), "key bigint, doc_id bigint, text_hash bigint, start bigint, bytes binary")

    with settings(spark, PRUNED):
        grouped = pieces(looked.filter(~crowded), True).repartition(tasks, "key").sortWithinPartitions("key")
        matched = cut_lineage(in_arrow(grouped, _order_suffixes(length), "doc_id bigint, text_hash bigint, start bigint, stop bigint"))
        if crowds:
            matched = matched.union(cut_lineage(_crowded_matches(pieces(looked.filter(crowded), False), length)))
    return found.filter("kind = 1").select("doc_id", "text_hash", "start", "stop").union(matched)


def _cut_texts(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """(doc_id, text_hash, kept, n_removed, n_spans) of the documents with ``removed`` (doc_id, text_hash, cuts); kept is binary."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("kept", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            cuts = batch.column("cuts")
            starts, stops = cuts.flatten().field("start").to_numpy(), cuts.flatten().field("stop").to_numpy()
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(cuts).to_numpy())])
            out: tuple[list, ...] = ([], [], [])
            for row, text in enumerate(batch.column("text").to_pylist()):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                own = slice(ends[row], ends[row + 1])
                gone = cover(np.minimum(starts[own], len(raw)), np.minimum(stops[own], len(raw)), len(raw))
                edges = np.diff(gone.astype(np.int8), prepend=np.int8(0))
                for column, value in zip(out, (raw[~gone].tobytes(), int(gone.sum()), int((edges == 1).sum())), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(c, t) for c, t in zip(out, schema.types[2:], strict=True))], schema=schema)

    with settings(docs.sparkSession, PRUNED):
        rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(removed.filter("doc_id > -9223372036854775808"), ["doc_id", "text_hash"])
        return cut_lineage(in_arrow(rows.select("doc_id", "text_hash", "text", "cuts"), run, "doc_id bigint, text_hash bigint, kept binary, n_removed bigint, n_spans bigint").distinct())


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, kept (binary), n_removed and n_spans (maximal removed runs) of every row of ``docs``.

    Strings are judged on the input, not on what is left, and compared as UTF-8 bytes, so ``kept`` may end within a
    character. Edge cases: a null text counts as empty, texts shorter than ``length`` bytes stay whole; rows without
    doc_id stay whole and are no one's earlier match; rows with the same doc_id and text are one document, and of
    different texts with one doc_id the one with the smaller hash is earlier. An empty table gives an empty result.
    """
    removed = cut_lineage(repeated_ranges(docs, length, gram).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("cuts")))
    shortened = _cut_texts(docs, removed)
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    joined = base.join(shortened, ["doc_id", "text_hash"], "left")
    return joined.select(
        "doc_id", "n_bytes", F.coalesce("kept", F.encode("text", "UTF-8")).alias("kept"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )


def repeat_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``remove_repeats`` with the digest of what is kept instead of the bytes; texts that stay whole are not shuffled."""
    removed = cut_lineage(repeated_ranges(docs, length, gram).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("cuts")))
    shortened = _cut_texts(docs, removed).select("doc_id", "text_hash", F.sha2("kept", 256).alias("kept_sha256"), "n_removed", "n_spans")
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    return base.join(shortened, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )
