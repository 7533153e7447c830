"""Packing of documents into token sequences, in order, by dynamic programming.

The ids of a block of neighbouring documents (``BLOCK`` doc_ids) form one stream. Cuts may fall at the end of a
document (free), a sentence, a clause, or, inside long stretches without any, at every ``FILLER`` ids; each kind has
its penalty, in ids. The best cuts minimise padding plus penalties: with padding linear in the length of a sequence,
the best start for each cut is the minimum of a sliding window, kept in a monotone queue, so a block takes linear time.
A sequence whose length is a power of two is not padded; those lengths are tried beside the queue.

Blocks depend on doc_ids alone, so the result does not depend on partitions and a lost task is simply run again.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.tasks import Batches, in_arrow
from spanmill.llm.tokenizing import Encoder, encoder, groups

SIZE, BLOCK, END_ID = 1024, 512, 0
FILLER = 16
#: Penalties, in ids of padding, of a cut after a sentence, after a clause and elsewhere; and of every sequence.
SENTENCE, CLAUSE, INSIDE, OPENING = 1.0, 2.0, 6.0, 8.0
#: The shortest sequence that may stand unpadded because its length is a power of two.
SHORTEST = 64


def cut_penalties(names: list[str]) -> np.ndarray:
    """Penalty of a cut after each id of a byte-level vocabulary; 0 where no cut is offered."""
    table = np.zeros(len(names))
    for number, name in enumerate(names):
        if name[-1:] in (".", "!", "?", "Ċ"):
            table[number] = SENTENCE
        elif name[-1:] in (",", ";", ":"):
            table[number] = CLAUSE
    return table


def offered_cuts(ids: np.ndarray, penalties: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, ascending from 0, and the penalty of each.

    Near its end there are more, so that the last sequences can have the lengths that need no padding.
    """
    offered = (penalties > 0)[ids]
    offered[doc_ends - 1] = True
    places = np.concatenate([[0], np.flatnonzero(offered) + 1])
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > FILLER)
    if len(wide):
        fill = [np.arange(a + FILLER, b, FILLER) for a, b in zip(places[wide], places[wide + 1], strict=True)]
        places = np.union1d(places, np.concatenate(fill))
    end = int(doc_ends[-1])
    places = np.union1d(places, np.arange(end - SHORTEST, max(end - 2 * SIZE, 0), -SHORTEST))
    cost = np.where(places > 0, penalties[ids[places - 1]], 0.0)
    cost[cost == 0] = INSIDE
    cost[np.isin(places, doc_ends)] = 0.0
    return places, cost


def best_cuts(places: list[int], cost: list[float], size: int = SIZE) -> list[int]:
    """Ends of the sequences: the cheapest way from the first to the last of ``places`` in steps of at most ``size``."""
    total, back = [0.0] * len(places), [0] * len(places)
    index = {place: i for i, place in enumerate(places)}
    powers = [1 << k for k in range(SHORTEST.bit_length() - 1, size.bit_length() - 1)]
    queue, keys = deque([0]), deque([float(places[0])])
    for j in range(1, len(places)):
        place = places[j]
        while places[queue[0]] < place - size:
            queue.popleft()
            keys.popleft()
        best, start = keys[0] + size - place, queue[0]
        for power in powers:
            i = index.get(place - power)
            if i is not None and total[i] < best:
                best, start = total[i], i
        total[j] = best = best + cost[j] + OPENING
        back[j] = start
        key = best + place
        while keys and keys[-1] >= key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j)
    ends, j = [], len(places) - 1
    while j > 0:
        ends.append(places[j])
        j = back[j]
    return ends[::-1]


def _block_pieces(block: int, doc_ids: list, tokens: list[np.ndarray], penalties: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    ids = np.concatenate(tokens)
    doc_ends = np.cumsum([len(t) for t in tokens])
    places, cost = offered_cuts(ids, penalties, doc_ends)
    ends = np.array(best_cuts(places.tolist(), cost.tolist()))
    edges = np.union1d(ends, doc_ends)
    starts = np.concatenate([[0], edges[:-1]])
    sequence, document = np.searchsorted(ends, starts, "right"), np.searchsorted(doc_ends, starts, "right")
    sequence_start = np.concatenate([[0], ends[:-1]])[sequence]
    doc_start = (doc_ends - [len(t) for t in tokens])[document]
    data = ids.astype("<u4").tobytes()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([doc_ids[d] for d in document], pa.int64()),
            pa.array(starts - doc_start),
            pa.array(edges - starts),
            pa.array(np.array([len(t) for t in tokens])[document], pa.int64()),
            pa.array((block << 24) + sequence),
            pa.array(starts - sequence_start),
            pa.array([data[4 * a : 4 * b] for a, b in zip(starts, edges, strict=True)], pa.binary()),
        ],
        schema=schema,
    )


def _block_number() -> Column:
    """Documents without an id are dealt by their text into blocks of their own."""
    return F.coalesce(F.floor(F.col("doc_id") / BLOCK), -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 12)) - (1 << 38)).cast("long")


def pack_pieces(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Pieces of packed documents: doc_id, start, length, doc_tokens, sequence_id, offset and ids (binary, 32 bits each).

    ``path`` is a byte-level vocabulary file. Every document's ids and ``end_id`` stand in order, cut into pieces; the
    pieces of one sequence_id are one sequence of at most ``SIZE`` ids, placed at their offsets without gaps.

    Edge cases: a null or empty text is its end id alone; rows that share a doc_id are documents of their own, in the
    order of their text's hash; rows without doc_id are packed in blocks of their own; an empty table gives an empty
    result. Other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def run(batches: Batches) -> Batches:
        own: Encoder = encoder(path, True)
        penalties = cut_penalties(own.pieces())
        end = np.array([end_id], np.uint32)
        block, doc_ids, tokens = None, [], []
        for number, doc_id, ids in _encoded(batches, own):
            if number != block and tokens:
                yield _block_pieces(block, doc_ids, tokens, penalties, schema)
                doc_ids, tokens = [], []
            block = number
            doc_ids.append(doc_id)
            tokens.append(np.concatenate([ids, end]))
        if tokens:
            yield _block_pieces(block, doc_ids, tokens, penalties, schema)

    rows = docs.select(_block_number().alias("block"), "doc_id", "text")
    dealt = rows.repartition("block").sortWithinPartitions("block", "doc_id", F.xxhash64("text"))
    return in_arrow(dealt, run, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def _encoded(batches: Batches, own: Encoder) -> Iterator[tuple[int, int | None, np.ndarray]]:
    for batch in batches:
        blocks, doc_ids = (batch.column(c).to_pylist() for c in ("block", "doc_id"))
        texts = batch.column("text")
        for begin, end in groups(texts):
            ids, counts = own.encode_column(texts.slice(begin, end - begin))
            yield from zip(blocks[begin:end], doc_ids[begin:end], np.split(ids, np.cumsum(counts)[:-1]), strict=True)


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
