"""Exact set-similarity self-join of word n-grams by universe partition and pigeonhole.

A document is the set of its distinct n-grams (hashed to 64 bits for the search; links are verified on the words).
Sets are dealt into size bands. Within a band the universe of n-grams is hashed into segments. Two sets of the band
that reach the threshold differ in at most H n-grams, so

* with *subsets* as signatures, of the first segments that hold at least two n-grams of a set, any H + 1 contain one
  in which both sets have the same n-grams;
* with *one-deletion neighbourhoods* (a segment's subset, and the subset without each one of its n-grams), every
  second difference may be spent, so H / 2 + 1 larger segments do.

``allocate`` chooses for each band by expected cost: subsets are fewer, neighbourhoods are more selective and need no
well-filled segments. Every set carries a reserve of signatures beyond the H + 1 that pigeonhole asks for, so
signatures that very many sets share may be left out as long as no set loses more of them than its reserve.

A shared signature never means all pairs. Its sets are first compared with one leader; where that joins them all, the
signature is done. Pairs of different classes are formed only for signatures of few sets, and are verified only if
they share as many signatures as the pigeonhole demands.

Sets that lose more signatures than their reserve, or whose n-grams fill too few segments, are few; any link between
two sets that the signatures miss lies between two of them. They are searched again by the n-grams themselves, rarest
first: sets of sizes a and b that share c n-grams have one of their a - c + 1 and b - c + 1 rarest in common. Keys carry
the steps of both sizes, so c is nearly that of the pair, and what many texts share stays out of the keys as long as a
text has enough of its own. Keys of many sets that share a set become one family.

A family of bounded size is settled by one task, which compares sets of different classes only, by sizes, parity bits
(of which a different n-gram changes at most one) and then all n-grams, until one link joins two classes.

The sets of a larger family are written as differences from one of them, the pivot: sets at distances d and e from it
with c differences in common are d + e - 2c apart. If they link with c = 0, both link with the set nearest to the
pivot, so one comparison for each set settles them. All others share one of their rarest differences, the more of them
the farther they lie; what the whole family has in common is no difference of any. Sets that share such a difference
are paired if they are few (and if sizes and parity bits allow a link), and are a smaller family otherwise. Rounds go on
while the largest family shrinks by a quarter; what then is left is dealt into blocks, and every two blocks are settled
by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.bytetext import mix, ranges, slices, windows
from spanmill.llm.components import components
from spanmill.llm.tasks import Batches, in_arrow
from spanmill.operators.skew import join_per_key
from spanmill.session import counted_copy, cut_lineage, settings, small_copy, work_path

WORDS, PERCENT = 5, 80
#: A signature of more sets than this is left out of pair forming (see the module's text for why none is lost).
FEW = 24
#: Sets of a family of which the most central one becomes its pivot.
LEADERS = 256
#: A family of at most so many sets, with at most so many n-grams in all, is settled by one task.
SETTLED_SETS, SETTLED_GRAMS = 4096, 2_000_000
#: A family of up to so many times these bounds is cut into blocks, of which every two are settled by one task.
BLOCKED = 4
#: Parity bits of a set, in longs of 64.
_PARITY_LONGS = 32
#: Texts whose signatures are dealt together, in bytes; bounds a task's memory.
CHUNK_BYTES = 8 << 20
_FILL = 2.6
_RATIO = 1.6
_SEED = np.uint64(0x51ED270B9F5A3E17)

#: Lets a shuffle of texts leave out, by a Bloom filter of bounded size, most texts that the other side does not ask for.
PRUNED = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "200MB",
}


@dataclass(frozen=True)
class Band:
    """Sets of ``low`` to ``high`` n-grams; pairs whose larger set is above ``floor`` belong here."""

    number: int
    low: int
    high: int
    segments: int
    deletions: bool


def differences(a: int, b: int, percent: int) -> int:
    """The most n-grams in which linked sets of these sizes differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Pigeonhole's demand of a set of ``size``: differences from its largest possible partner, and one."""
    return (size + 100 * size // percent) * (100 - percent) // (100 + percent) + 1


def reserve(size: np.ndarray) -> np.ndarray:
    return 2 + size // 100


def allocate(high: int, low: int, percent: int) -> tuple[int, bool]:
    """Segments of a band and whether it uses one-deletion neighbourhoods, by the cost of a set of middle size."""
    halves = differences(high, high, percent) // 2 + 1
    with_deletions = (halves + (2 if high > 8 else 0), True)
    segments = max(1, round(high / _FILL))
    for size in (low, high):
        fill = size / segments
        usable = segments * (1 - np.exp(-fill) * (1 + fill))
        asked = int(needed(np.array(size), percent) + reserve(np.array(size)))
        if usable < asked - 0.02 * size:
            return with_deletions
    middle = (low + high) // 2
    subset_cost = int(needed(np.array(middle), percent) + reserve(np.array(middle)))
    return (segments, False) if subset_cost < middle + with_deletions[0] else with_deletions


@lru_cache
def bands(percent: int) -> tuple[Band, ...]:
    found, below, high = [], 0, 8
    while below < 1 << 40:
        low = -(-(below + 1) * percent // 100)
        segments, deletions = allocate(high, low, percent)
        found.append(Band(len(found), low, high, segments, deletions))
        below, high = high, int(high * _RATIO)
    return tuple(found)


def _unique_shingles(s, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes and their text numbers, by text; texts with fewer words give their whole sequence."""
    starts, ends, owner = s.spans("space")
    hashes = s.hashes(starts, ends)
    first, grams = windows(hashes, owner, words)
    owners = owner[first]
    counts = np.bincount(owner, minlength=s.n)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        begin = np.searchsorted(owner, short)
        whole = np.array([int(mix(np.array([hash_run(hashes[b : b + counts[t]])], np.uint64))[0]) for b, t in zip(begin, short, strict=True)], np.uint64)
        grams, owners = np.concatenate([grams, whole]), np.concatenate([owners, short])
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    return grams[fresh], owners[fresh]


def hash_run(values: np.ndarray) -> int:
    total = len(values)
    for v in values.tolist():
        total = (total * 0xD6E8FEB86659FD93 + v + 1) & 0xFFFFFFFFFFFFFFFF
    return total


def _per_text(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Sums (modulo 2**64) of ``values`` for each text; ``owners`` ascend."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    bounds = np.searchsorted(owners, np.arange(n + 1))
    return total[bounds[1:]] - total[bounds[:-1]]


def _set_ids(grams: np.ndarray, owners: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ids of the sets: equal sets, equal ids, wherever they are met."""
    return mix(_per_text(mix(grams ^ _SEED), owners, len(sizes)) ^ mix(sizes.astype(np.uint64))).view(np.int64)


def _band_signatures(band: Band, grams: np.ndarray, owners: np.ndarray, sizes: np.ndarray, percent: int):
    """Signatures of one band: values, text numbers, and by how much each text falls short of its demand."""
    member = (sizes >= band.low) & (sizes <= band.high)
    demand = needed(sizes, percent)
    member &= demand > 1  # the others are linked with equal sets only
    lost = np.zeros(len(sizes), np.int64)
    mine = member[owners]
    if not mine.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), member, lost
    g, o = grams[mine], owners[mine]
    salt = mix(np.array([band.number + (1 << 20 if band.deletions else 0)], np.uint64) ^ _SEED)[0]
    segment = (mix(g ^ salt) % np.uint64(band.segments)).astype(np.int64)
    key = o * band.segments + segment
    order = np.argsort(key, kind="stable")
    key, g = key[order], mix(g[order])
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(begin, len(key)))
    total = np.add.reduceat(g, begin)
    place, text = key[begin] % band.segments, key[begin] // band.segments
    usable = length >= 2 if band.segments > 1 else length >= 1
    salted = mix(place.astype(np.uint64) ^ salt)
    per_text = np.bincount(text[usable], minlength=len(sizes))
    if band.deletions:
        halves = (demand - 1) // 2 + 1
        lost[member] = (halves - per_text)[member]
        # A segment of one n-gram counts for nothing, but is what a partner's segment of two becomes by one deletion.
        several = np.flatnonzero(length >= 2)
        every = np.repeat(several, length[several])
        less = total[every] - g[ranges(begin[several], length[several])]
        values = np.concatenate([total, less]) ^ np.concatenate([salted, salted[every]])
        texts = np.concatenate([text, text[every]])
    else:
        begin, length, total, text, salted = (x[usable] for x in (begin, length, total, text, salted))
        quota = demand + reserve(sizes)
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        chosen = rank < quota[text]
        values, texts = total[chosen] ^ salted[chosen], text[chosen]
        lost[member] = (demand - np.minimum(per_text, quota) + reserve(sizes) - reserve(sizes * percent // 100))[member]
    return mix(values), texts, member, lost


def _signature_rows(words: int, percent: int, parts: int):
    """Batches of (doc_id, text, text_hash) to blocks of signatures by part, and one row for each document."""
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("block", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("size", pa.int64()), ("node", pa.int64()), ("lost", pa.int64())])

    def deal(values, nodes, turn) -> Iterator[pa.RecordBatch]:
        """Blocks of (signature, node). Sets that share a signature within the chunk are told apart here: one leads."""
        order = np.lexsort((nodes, values))
        values, nodes = values[order], nodes[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (nodes[1:] != nodes[:-1])
        values, nodes = values[fresh] & ~np.uint64(1), nodes[fresh]
        head = np.ones(len(values), bool)
        head[1:] = values[1:] != values[:-1]
        leader = np.flatnonzero(head)[np.cumsum(head) - 1]
        crowd = np.diff(np.append(np.flatnonzero(head), len(values))) > 1
        sent, sent_nodes = values[head] | crowd, nodes[head]
        part = (mix(sent | np.uint64(1)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        blocks, numbers = [], []
        for p in range(parts):
            own = order[cuts[p] : cuts[p + 1]]
            if len(own):
                numbers.append(p)
                blocks.append(np.concatenate([sent[own].view(np.int64), sent_nodes[own]]).tobytes())
        rest = ~head
        kinds = [0] * len(blocks)
        if rest.any():
            numbers.append(turn % parts)
            blocks.append(np.concatenate([values[rest].view(np.int64), nodes[rest], nodes[leader[rest]]]).tobytes())
            kinds.append(1)
        none = [None] * len(blocks)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(kinds, pa.int8()), pa.array(blocks, pa.binary()), *(pa.array(none, pa.int64()) for _ in range(5))], schema=schema)

    def run(batches: Batches) -> Batches:
        held_values, held_nodes, held, turn = [], [], 0, 0
        for batch in batches:
            for s in slices(batch.column("text")):
                turn += 1
                ids, hashes = (batch.column(c).slice(s.first, s.n) for c in ("doc_id", "text_hash"))
                s = s.lower()
                grams, owners = _unique_shingles(s, words)
                sizes = np.bincount(owners, minlength=s.n)
                nodes = _set_ids(grams, owners, sizes)
                worst = np.full(s.n, -(1 << 30), np.int64)
                for band in bands(percent):
                    if not ((sizes >= band.low) & (sizes <= band.high)).any():
                        continue
                    values, texts, member, lost = _band_signatures(band, grams, owners, sizes, percent)
                    worst = np.where(member, np.maximum(worst, lost), worst)
                    held_values.append(values)
                    held_nodes.append(nodes[texts])
                n = s.n
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.arange(n) + turn) % parts, pa.int32()), pa.array(np.full(n, 2), pa.int8()), pa.nulls(n, pa.binary()), ids, hashes, pa.array(sizes, pa.int64()), pa.array(nodes), pa.array(worst)],
                    schema=schema,
                )
                held += len(s.data)
                if held > CHUNK_BYTES:
                    yield from deal(np.concatenate(held_values), np.concatenate(held_nodes), turn)
                    held_values, held_nodes, held = [], [], 0
        if held_values:
            yield from deal(np.concatenate(held_values), np.concatenate(held_nodes), turn)

    return run


def _shared(batches: Batches) -> Batches:
    """Of the dealt signatures, those that several sets have: one row for each set, with the set to compare it with.

    Rows come in the order of their part, and one part is held at a time.
    """
    schema = pa.schema([("kind", pa.int8()), ("signature", pa.int64()), ("node", pa.int64()), ("leader", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("size", pa.int64()), ("lost", pa.int64())])

    def rows(signature, node, leader, known) -> pa.RecordBatch:
        none = pa.nulls(len(node), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(node)), pa.int8()), pa.array(signature), pa.array(node), pa.array(leader, mask=~known), none, none, none, none], schema=schema)

    def settle(pairs: list[np.ndarray]) -> Batches:
        signature, node = np.concatenate(pairs, axis=1)
        crowd, signature = (signature & 1).astype(bool), signature & ~np.int64(1)
        order = np.lexsort((node, signature))
        signature, node, crowd = signature[order], node[order], crowd[order]
        other = signature[1:] != signature[:-1]
        fresh = np.concatenate([[True], other | (node[1:] != node[:-1])])
        begin = np.flatnonzero(np.concatenate([[True], other]))
        run = np.cumsum(np.concatenate([[False], other]))
        many = (np.add.reduceat(fresh.astype(np.int64), begin) > 1) | np.maximum.reduceat(crowd, begin)
        leader = node[begin][run]
        kept = np.flatnonzero(fresh & many[run])
        for at in range(0, len(kept), 1 << 16):
            own = kept[at : at + (1 << 16)]
            yield rows(signature[own], node[own], leader[own], leader[own] != node[own])

    part, pairs = None, []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        documents = batch.filter(pa.array(kinds == 2))
        if len(documents):
            n = len(documents)
            yield pa.RecordBatch.from_arrays(
                [documents.column("kind"), pa.nulls(n, pa.int64()), documents.column("node"), pa.nulls(n, pa.int64()), *(documents.column(c) for c in ("doc_id", "text_hash", "size", "lost"))],
                schema=schema,
            )
        for number, kind, block in zip(batch.column("part").to_pylist(), kinds, batch.column("block"), strict=True):
            if kind == 0:
                if number != part and pairs:
                    yield from settle(pairs)
                    pairs = []
                part = number
                pairs.append(np.frombuffer(block.as_buffer(), np.int64).reshape(2, -1).copy())
            elif kind == 1:
                three = np.frombuffer(block.as_buffer(), np.int64).reshape(3, -1)
                yield rows(three[0], three[1], three[2], np.ones(three.shape[1], bool))
    if pairs:
        yield from settle(pairs)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash): rows may share an id, so a text is known by both."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def _search(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(signature, node, leader) of the shared signatures; (doc_id, text_hash, size, node, lost) of every document."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * tasks
    dealt = in_arrow(_keyed(docs), _signature_rows(words, percent, parts), "part int, kind byte, block binary, doc_id bigint, text_hash bigint, size bigint, node bigint, lost bigint")
    path = work_path(spark, "signatures")
    in_arrow(dealt.repartition(tasks, "part").sortWithinPartitions("part"), _shared, "kind byte, signature bigint, node bigint, leader bigint, doc_id bigint, text_hash bigint, size bigint, lost bigint").write.partitionBy("kind").parquet(path)
    found = spark.read.schema("kind int, signature bigint, node bigint, leader bigint, doc_id bigint, text_hash bigint, size bigint, lost bigint").parquet(path)
    return found.filter("kind = 1").select("signature", "node", "leader").distinct(), found.filter("kind = 2").select("doc_id", "text_hash", "size", "node", "lost")


def _plain_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lowered, r"[\x20\x09-\x0D]+", " "))


def _grams(text: str, words: int) -> set:
    parts = text.split(" ")
    return {tuple(parts)} if len(parts) < words else set(zip(*(parts[k:] for k in range(words)), strict=False))


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame | None:
    """The pairs (a, b) whose texts reach the threshold, compared on the words themselves; None if none does."""

    def run(batches: Batches) -> Batches:
        known: dict[int, set] = {}
        for batch in batches:
            linked = []
            for a, b, left, right in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "left", "right")), strict=True):
                if a not in known:
                    known = {a: _grams(left, words)}
                one, two = known[a], _grams(right, words)
                common = len(one & two)
                linked.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("words").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("words").alias("right"))
    linked, count, _ = counted_copy(in_arrow(pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right"), run, "a bigint, b bigint"), F.lit(False))
    return linked if count else None


def _documents_of(nodes: DataFrame, docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(node, doc_id, text) for ``nodes`` (node): the first document of each."""
    wanted = cut_lineage(nodes.join(facts.filter("doc_id IS NOT NULL").select("node", "doc_id", "text_hash"), "node"))
    with settings(docs.sparkSession, PRUNED):
        return cut_lineage(_keyed(docs).join(wanted.filter("doc_id > -9223372036854775808"), ["doc_id", "text_hash"]).select("node", "doc_id", "text"))


def _texts_among(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``texts`` (node, text) with one of ``nodes`` (node)."""
    with settings(texts.sparkSession, PRUNED):
        return cut_lineage(texts.join(nodes.filter(F.col("node") >= -(1 << 63)), "node"))


def _verified(pairs: DataFrame, texts_of, words: int, percent: int) -> DataFrame | None:
    """The pairs (a, b) that reach the threshold; None if there are none. ``texts_of`` gives (node, text) of nodes (node)."""
    pairs = small_copy(pairs)
    if pairs.isEmpty():
        return None
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = texts_of(ends).select("node", _plain_words(F.col("text")).alias("words")).dropDuplicates(["node"])
    return _verify(pairs, texts, words, percent)


def _plausible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b, together) those whose sizes and number of common signatures allow a link.

    Linked sets share at least 1 - lost signatures, of which those that crowds share were not counted.
    """
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("size", "lost", "crowded"))), side)
    sizes = F.lit(100) * F.least("size_a", "size_b") >= F.lit(percent) * F.greatest("size_a", "size_b")
    shares = F.col("together") >= F.lit(1) - F.greatest("lost_a", "lost_b") - F.least("crowded_a", "crowded_b")
    return pairs.filter(sizes & shares).select("a", "b")


def _pairs_between(rows: DataFrame, plausible: Column | None = None) -> DataFrame:
    """(a, b, together): sets of different classes and how many signatures of ``rows`` they share, those of ``plausible`` only."""
    one, two = rows.alias("one"), rows.alias("two")
    met = (F.col("one.signature") == F.col("two.signature")) & (F.col("one.node") < F.col("two.node")) & (F.col("one.class") != F.col("two.class"))
    if plausible is not None:
        met &= plausible
    return one.join(two, met).groupBy(F.col("one.node").alias("a"), F.col("two.node").alias("b")).agg(F.count(F.lit(1)).alias("together"))


def _still_open(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """``shared`` with class and sets: the signatures whose sets are not all in one class yet, and how many sets they have."""
    return _mixed(small_copy(shared.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")))


def _mixed(classed: DataFrame) -> DataFrame:
    """The rows of the signatures that have several classes, with their number of sets."""
    mixed = classed.groupBy("signature").agg(F.count(F.lit(1)).alias("sets"), F.min("class").alias("low"), F.max("class").alias("high"))
    mixed = small_copy(mixed.withColumn("key_rows", F.col("sets")))
    joined = join_per_key(classed, mixed, ["signature"], "node", how="inner", match=F.col("low") != F.col("high"), hot_floor=5_000)
    return small_copy(joined.drop("low", "high"))


# ---- sets that the signatures cannot speak for ----

#: Sizes of one step differ by at most this ratio.
_STEP_RATIO = 1.02


@lru_cache
def steps() -> np.ndarray:
    """The smallest size of every step."""
    found = [1]
    while found[-1] < 1 << 40:
        found.append(max(found[-1] + 1, int(found[-1] * _STEP_RATIO)))
    return np.array(found, np.int64)


def least_common(a, b, percent: int):
    """The fewest common n-grams of linked sets of sizes ``a`` and ``b``; of numbers or columns of numbers."""
    return -(-percent * (a + b) // (100 + percent))


def _gram_rows(words: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for s in slices(batch.column("text")):
                nodes = batch.column("node").slice(s.first, s.n)
                grams, owners = _unique_shingles(s.lower(), words)
                for at in range(0, len(grams), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([nodes.take(pa.array(owners[part])), pa.array(grams[part].view(np.int64))], ["node", "gram"])

    return run


def _prefix_rows(percent: int):
    """Sets with their n-grams (n, gram), rarest first, to keys of the rarest: (signature, node, place, size)."""

    def run(batches: Batches) -> Batches:
        lowest = steps()
        for batch in batches:
            found = []
            for node, listed in zip(batch.column("node").to_pylist(), batch.column("grams"), strict=True):
                counts, grams = (listed.values.field(k).to_numpy() for k in (0, 1))
                size = len(grams)
                smallest, largest = -(-percent * size // 100), 100 * size // percent
                own = int(np.searchsorted(lowest, size, "right")) - 1
                first, last = (int(np.searchsorted(lowest, x, "right")) - 1 for x in (smallest, largest))
                for other in range(first, last + 1):
                    partner = max(int(lowest[other]), smallest)
                    # An n-gram that no other set has keeps its place but makes no key.
                    place = np.flatnonzero(counts[: size - least_common(size, partner, percent) + 1] > 1)
                    steps_ = np.uint64((min(own, other) << 32) | max(own, other))
                    found.append((mix(grams[place].view(np.uint64) ^ mix(np.array([steps_]))[0]).view(np.int64), np.full(len(place), node), place, np.full(len(place), size)))
            if found:
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                for at in range(0, len(columns[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)], pa.int64()) for c in columns], ["signature", "node", "place", "size"])

    return run


def _ranked_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, grams) of the sets of ``texts`` (node, text): n-grams with the number of sets that have them, rarest first."""
    grams = cut_lineage(in_arrow(texts.select("node", "text"), _gram_rows(words), "node bigint, gram bigint"))
    counts = cut_lineage(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).withColumn("key_rows", F.col("n")))
    ranked = join_per_key(grams, counts, ["gram"], "node", hot_floor=5_000)
    return cut_lineage(ranked.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams")))


def _reach(one: str, two: str, percent: int) -> Column:
    """Whether sets that meet in these places can have enough in common behind them, if it is their first meeting."""
    def of(name: str) -> tuple[Column, Column]:
        return F.col(f"{one}.{name}"), F.col(f"{two}.{name}")

    (size_a, size_b), (place_a, place_b) = of("size"), of("place")
    return F.least(size_a - place_a, size_b - place_b) * (100 + percent) >= percent * (size_a + size_b)


def _parity_longs(grams: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Parity bits of ``n`` sets, a row of longs for each; every n-gram flips one."""
    width = 64 * _PARITY_LONGS
    flips = np.bincount(owners * width + (mix(grams) % np.uint64(width)).astype(np.int64), minlength=n * width) & 1
    return np.packbits(flips.astype(np.uint8).reshape(-1, 64), axis=1).view(np.int64).reshape(-1, _PARITY_LONGS)


def _parities(texts: DataFrame, words: int) -> DataFrame:
    """(node, bits): for each set as many parity bits as ``_PARITY_LONGS`` longs hold; every n-gram flips one."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for s in slices(batch.column("text")):
                grams, owners = _unique_shingles(s.lower(), words)
                packed = _parity_longs(grams, owners, s.n)
                offsets = pa.array(np.arange(s.n + 1) * _PARITY_LONGS, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(s.first, s.n), pa.ListArray.from_arrays(offsets, pa.array(packed.ravel()))], ["node", "bits"])

    return cut_lineage(in_arrow(texts.select("node", "text"), run, "node bigint, bits array<bigint>"))


def _may_link(one: str, two: str, percent: int) -> Column:
    """Whether sizes and parity bits allow a link."""
    def of(name: str) -> tuple[Column, Column]:
        return F.col(f"{one}.{name}"), F.col(f"{two}.{name}")

    (size_a, size_b), (bits_a, bits_b) = of("size"), of("bits")
    apart = F.aggregate(F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda sum_, n: sum_ + n)
    sizes = 100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)
    return sizes & (apart * (100 + percent) <= (size_a + size_b) * (100 - percent))


def _leader_pairs(rows: DataFrame, allowed) -> DataFrame:
    """One set of every signature against its other sets: (a, b) of different classes that ``allowed`` lets pass.

    A set of the class with the fewest sets in the signature leads.
    """
    kept = [c for c in rows.columns if c not in ("signature", "sets")]
    per_class = small_copy(rows.groupBy("signature", "class").agg(F.count(F.lit(1)).alias("key_rows")).withColumn("kin", F.col("key_rows")))
    rows = small_copy(join_per_key(rows, per_class, ["signature", "class"], "node", hot_floor=5_000))
    first = small_copy(rows.groupBy("signature").agg(F.min(F.struct("kin", *kept)).alias("two"), F.count(F.lit(1)).alias("key_rows")))
    met = join_per_key(rows, first, ["signature"], "node", hot_floor=5_000).select(F.struct(*kept).alias("one"), "two")
    other = (F.col("one.class") != F.col("two.class")) & (F.col("one.node") != F.col("two.node"))
    met = met.filter(F.when(other, allowed("one", "two")).otherwise(False))
    return met.select(F.least("one.node", "two.node").alias("a"), F.greatest("one.node", "two.node").alias("b")).distinct()


def _families(rows: DataFrame) -> DataFrame:
    """(signature, node, size): the sets of all keys that have the same set of smallest hash, under that set."""
    found = rows.groupBy("signature").agg(F.min(F.struct(F.xxhash64("node").alias("hash"), "node")).alias("found"), F.count(F.lit(1)).alias("key_rows"))
    found = small_copy(found.select("signature", F.col("found.node").alias("family"), "key_rows"))
    met = join_per_key(rows.select("signature", "node", "size"), found, ["signature"], "node", hot_floor=5_000)
    return small_copy(met.select(F.col("family").alias("signature"), "node", "size").distinct())


def _central(rows: DataFrame, bits: DataFrame, leaders: int) -> DataFrame:
    """(signature, pivot): of up to ``leaders`` sets of each family the one whose parity bits differ least from those of the others."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            pivots = []
            for listed in batch.column("drawn"):
                nodes, packed = (listed.values.field(k) for k in (0, 1))
                packed = packed.flatten().to_numpy().view(np.uint64).reshape(len(nodes), -1)
                apart = [int(np.bitwise_count(packed ^ own).sum()) for own in packed]
                pivots.append(nodes[int(np.argmin(apart))].as_py())
            yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array(pivots, pa.int64())], ["signature", "pivot"])

    slot = F.pmod(F.xxhash64("node"), F.lit(leaders)).alias("slot")
    drawn = rows.groupBy("signature", slot).agg(F.min("node").alias("node")).join(bits, "node")
    listed = drawn.groupBy("signature").agg(F.array_sort(F.collect_list(F.struct("node", "bits"))).alias("drawn"))
    return cut_lineage(in_arrow(listed, run, "signature bigint, pivot bigint"))


def _difference_rows(batches: Batches) -> Batches:
    """Sets with their pivot's to their distance and their differences in order, rarest in the family first.

    A difference that no other set can have keeps its place but is left out.
    """
    for batch in batches:
        distances, places, found = [], [], []
        for many, own, base in zip(batch.column("family_rows").to_pylist(), batch.column("grams"), batch.column("base"), strict=True):
            (counts, grams), (base_counts, base_grams) = ([x.values.field(k).to_numpy() for k in (0, 1)] for x in (own, base))
            more, less = ~np.isin(grams, base_grams), ~np.isin(base_grams, grams)
            differing = np.concatenate([grams[more], base_grams[less]])
            rarity = np.concatenate([counts[more], many - base_counts[less]])
            alone = np.concatenate([counts[more] <= 1, np.zeros(int(less.sum()), bool)])
            order = np.lexsort((differing, rarity))
            place = np.flatnonzero(~alone[order])
            distances.append(len(differing))
            places.append(place)
            found.append(differing[order][place])
        yield pa.RecordBatch.from_arrays(
            [batch.column("signature"), batch.column("node"), batch.column("size"), batch.column("class"), pa.array(distances, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))],
            ["signature", "node", "size", "class", "distance", "places", "differing"],
        )


def _differences(rows: DataFrame, pivots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``rows`` (signature, node, size, class) with the differences from the pivot of their family.

    ``near`` is what a set brings to a link: sets without a common difference link if their sum is not negative.
    """
    many = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("key_rows")).withColumn("family_rows", F.col("key_rows"))
    bases = cut_lineage(many.join(pivots, "signature").join(sets.select(F.col("node").alias("pivot"), F.col("grams").alias("base")), "pivot").drop("pivot"))
    met = join_per_key(rows.join(sets, "node"), bases, ["signature"], "node", hot_floor=5_000)
    met = met.select("signature", "node", "size", "class", "family_rows", "grams", "base")
    apart = in_arrow(met, _difference_rows, "signature bigint, node bigint, size bigint, class bigint, distance bigint, places array<bigint>, differing array<bigint>")
    return cut_lineage(apart.withColumn("near", (100 - percent) * F.col("size") - (100 + percent) * F.col("distance")))


def _settled_by_nearest(apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) of the set nearest to each pivot and those that link with it without a common difference, unless of its class; ``apart`` with all these in its class."""
    nearest = apart.groupBy("signature").agg(F.max(F.struct("near", "node", "class")).alias("top"), F.count(F.lit(1)).alias("key_rows"))
    met = cut_lineage(join_per_key(apart, small_copy(nearest), ["signature"], "node", hot_floor=5_000))
    links = F.col("near") + F.col("top.near") >= 0
    pairs = met.filter(links & (F.col("class") != F.col("top.class"))).select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b")).distinct()
    return pairs, met.withColumn("class", F.when(links, F.col("top.class")).otherwise(F.col("class"))).drop("top")


def _difference_keys(apart: DataFrame, percent: int) -> DataFrame:
    """(family, signature, node, place, size, distance, near, class, sets): keys of the rarest differences that sets of several classes share.

    A set is asked for as many as any set of another class in its family must have in common with it.
    """
    per_class = small_copy(apart.groupBy("signature", "class").agg(F.max("near").alias("near"), F.count(F.lit(1)).alias("key_rows")))
    top = per_class.groupBy("signature").agg(F.max(F.struct("near", "class")).alias("top"), F.sum("key_rows").alias("key_rows"))
    others = per_class.join(top.select("signature", "top"), "signature").filter(F.col("class") != F.col("top.class"))
    best = small_copy(others.groupBy("signature").agg(F.max("near").alias("second")).join(top, "signature"))
    met = join_per_key(apart, best, ["signature"], "node", how="inner", hot_floor=5_000)
    partner = F.when(F.col("class") == F.col("top.class"), F.col("second")).otherwise(F.col("top.near"))
    common = F.greatest(F.lit(1), F.ceil(-(F.col("near") + partner) / (2 * (100 + percent))))
    first = met.withColumn("kept", F.col("distance") - common + 1).withColumn("key", F.explode(F.filter(F.arrays_zip("places", "differing"), lambda x: x["places"] < F.col("kept"))))
    return _mixed(small_copy(first.select(
        F.col("signature").alias("family"), F.xxhash64("signature", "key.differing").alias("signature"), "node", F.col("key.places").alias("place"), "size", "distance", "near", "class"
    )))


def _smaller_families(rows: DataFrame) -> DataFrame:
    """(signature, node, size, class): the sets of all keys of one family that have the same set nearest to its pivot.

    The pivot itself has no differences, so the smaller families lack it and rounds come to an end.
    """
    nearest = rows.groupBy("signature").agg(F.max(F.struct("near", F.xxhash64("node").alias("hash"), "node")).alias("top"), F.count(F.lit(1)).alias("key_rows"))
    nearest = small_copy(nearest.select("signature", F.col("top.node").alias("nearest"), "key_rows"))
    met = join_per_key(rows.select("family", "signature", "node", "size", "class"), nearest, ["signature"], "node", hot_floor=5_000)
    return _mixed(small_copy(met.select(F.xxhash64("family", "nearest").alias("signature"), "node", "size", "class").distinct()))


def _family_links(nodes: np.ndarray, classes: np.ndarray, sizes: np.ndarray, grams: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(a, b) that connect what the links of a family connect. A set meets those of other classes, until one link joins two classes."""
    order = np.argsort(sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    nodes, classes, sizes = nodes[order], np.unique(classes[order], return_inverse=True)[1], sizes[order]
    longs = np.empty((len(nodes), _PARITY_LONGS), np.uint64)
    for at in range(0, len(nodes), 256):
        many = sizes[at : at + 256]
        longs[at : at + 256] = _parity_longs(grams[ranges(begin[at : at + 256], many)].view(np.uint64), np.repeat(np.arange(len(many)), many), len(many)).view(np.uint64)
    numbers = np.unique(grams, return_inverse=True)[1].astype(np.int32)
    mine, links = np.zeros(len(numbers), bool), []
    last = np.searchsorted(sizes, 100 * sizes // percent, "right")
    for k in range(len(nodes) - 1):
        if classes.min() == classes.max():
            break
        others = np.arange(k + 1, last[k])
        others = others[classes[others] != classes[k]]
        most = differences(sizes[k], sizes[others], percent)
        others = others[np.bitwise_count(longs[others] ^ longs[k]).sum(axis=1) <= most]
        if not len(others):
            continue
        own, many = numbers[begin[k] : begin[k] + sizes[k]], sizes[others]
        mine[own] = True
        common = np.add.reduceat(mine[numbers[ranges(begin[others], many)]].astype(np.int64), np.cumsum(many) - many)
        mine[own] = False
        for other in others[100 * common >= percent * (sizes[k] + many - common)]:
            if classes[other] != classes[k]:
                links.append((int(min(nodes[k], nodes[other])), int(max(nodes[k], nodes[other]))))
                classes[classes == classes[other]] = classes[k]
    return links


def _family_rows(percent: int):
    """Sets (signature, node, class, grams) in the order of their family to the links (a, b) of each; one family is held at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        family = pa.Table.from_batches(held)
        listed = family.column("grams").combine_chunks()
        links = _family_links(*(family.column(c).to_numpy() for c in ("node", "class")), listed.value_lengths().to_numpy().astype(np.int64), listed.flatten().to_numpy(), percent)
        return pa.RecordBatch.from_arrays([pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)], schema=schema)

    def run(batches: Batches) -> Batches:
        family, held = None, []
        for batch in batches:
            signatures = batch.column("signature").to_numpy()
            cuts = np.flatnonzero(signatures[1:] != signatures[:-1]) + 1
            for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(signatures)], strict=True):
                if first == end:
                    continue
                if held and signatures[first] != family:
                    yield settle(held)
                    held = []
                family = signatures[first]
                held.append(batch.slice(first, end - first))
        if held:
            yield settle(held)

    return run


def _blocks(rows: DataFrame) -> DataFrame:
    """(signature, node, class): families of ``rows`` (with weight, their size in bounds) above the bounds as one family for every two of their blocks."""
    blocks = F.when(F.col("weight") <= 1, 1).otherwise(F.ceil(2 * F.col("weight"))).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("slot", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter((F.col("blocks") == 1) | (F.col("slot") != F.col("other")))
    two = F.xxhash64("signature", F.least("slot", "other"), F.greatest("slot", "other"))
    return met.select(F.when(F.col("blocks") == 1, F.col("signature")).otherwise(two).alias("signature"), "node", "class")


def _settled(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect what the links within each family of ``rows`` (signature, node, class) connect."""
    met = rows.join(sets, "node").select("signature", "node", "class", F.col("grams.gram").alias("grams"))
    return in_arrow(met.repartition("signature").sortWithinPartitions("signature"), _family_rows(percent), "a bigint, b bigint").distinct()


def _rest(texts: DataFrame, classes, add, words: int, percent: int) -> None:
    """Add the links between the sets of ``texts`` (node, text) that ``classes()`` does not connect yet.

    First one leader for each key, which settles groups of copies; then pairs where few sets share a key; then families
    in one task each or, if they are large, by differences from their pivots, each round with smaller ones.
    """
    def reach(one: str, two: str) -> Column:
        return _reach(one, two, percent)

    sets = _ranked_sets(texts, words)
    keys = cut_lineage(in_arrow(sets, _prefix_rows(percent), "signature bigint, node bigint, place bigint, size bigint"))
    rows = _still_open(keys, classes())
    add(_leader_pairs(rows, reach))
    rows = _still_open(rows.select("signature", "node", "place", "size"), classes())
    add(_pairs_between(rows.filter(F.col("sets") <= FEW), reach("one", "two")).select("a", "b"))
    rows, crowded, _ = counted_copy(rows.filter(F.col("sets") > FEW), F.lit(False))
    if not crowded:
        return
    rows, bits, before = _families(rows), None, inf
    common = F.least(F.col("one.distance") - F.col("one.place"), F.col("two.distance") - F.col("two.place"))
    enough = 2 * (100 + percent) * common >= -(F.col("one.near") + F.col("two.near"))
    while True:
        rows = _still_open(rows, classes())
        if rows.isEmpty():
            return
        weight = small_copy(rows.groupBy("signature").agg(F.greatest(F.max("sets") / SETTLED_SETS, F.sum("size") / SETTLED_GRAMS).alias("weight")))
        largest = weight.agg(F.max("weight")).first()[0]
        bound = BLOCKED if largest <= 0.75 * before else inf
        before = largest
        rows = rows.join(weight, "signature")
        add(_settled(_blocks(rows.filter(F.col("weight") <= bound)), sets, percent))
        if largest <= bound:
            return
        rows = _still_open(rows.filter(F.col("weight") > bound).select("signature", "node", "size"), classes())
        if rows.isEmpty():
            return
        if bits is None:
            bits = _parities(texts.join(rows.select("node").distinct(), "node", "left_semi"), words)
        pairs, apart = _settled_by_nearest(_differences(rows, _central(rows, bits, LEADERS), sets, percent))
        add(pairs)
        keys = _difference_keys(apart, percent)
        pairs = _pairs_between(keys.filter(F.col("sets") <= FEW), enough).select("a", "b")
        for side, name in (("a", "one"), ("b", "two")):
            known = sets.select("node", F.size("grams").cast("long").alias("size")).join(bits, "node")
            pairs = pairs.join(known.select(F.col("node").alias(side), F.struct("size", "bits").alias(name)), side)
        add(pairs.filter(_may_link("one", "two", percent)).select("a", "b"))
        crowded = keys.filter(F.col("sets") > FEW)
        if crowded.isEmpty():
            return
        rows = _smaller_families(crowded).select("signature", "node", "size")


def jaccard_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[list[DataFrame], DataFrame]:
    """Tables of links (a, b) between sets, and (doc_id, text_hash, size, node, lost) of all documents.

    The links are not all pairs that reach the threshold: they connect exactly the sets that all of them connect.
    """
    links: list[DataFrame] = []
    known: dict[int, DataFrame] = {}

    def add(pairs: DataFrame, texts_of=lambda nodes: _documents_of(nodes, docs, facts)) -> None:
        found = _verified(pairs, texts_of, words, percent)
        if found is not None:
            links.append(found)

    def classes() -> DataFrame:
        """Of the links so far; found once for each table that was added."""
        if len(links) not in known:
            known[len(links)] = _classes(docs, links)
        return known[len(links)]

    shared, documents = _search(docs, words, percent)
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("first")
    sets = documents.groupBy("node").agg(F.min("size").alias("size"), F.max("lost").alias("lost"), first)
    facts = cut_lineage(sets.select("node", "size", "lost", "first.*", F.lit(0).alias("crowded")))
    # Leaders first: a group of copies is joined by one comparison for each of its sets.
    star = shared.filter("leader is not null").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("together"))
    add(_plausible(star, facts, percent))
    # Then pairs of different classes, where few sets share a signature.
    rows = _still_open(shared.select("signature", "node"), classes())
    crowded = rows.filter(F.col("sets") > FEW).groupBy("node").agg(F.count(F.lit(1)).alias("crowded"))
    facts = cut_lineage(facts.drop("crowded").join(crowded, "node", "left").fillna(0, ["crowded"]))
    add(_plausible(_pairs_between(rows.filter(F.col("sets") <= FEW)), facts, percent))
    # Sets that fall short of the pigeonhole's demand are searched again, by their rarest n-grams.
    left, count, _ = counted_copy(facts.filter((F.col("lost") + F.col("crowded") > 0) & F.col("doc_id").isNotNull()).select("node"), F.lit(False))
    if count:
        # Written once: every pair that is left lies between these texts, so no round reads all documents again.
        texts = cut_lineage(_documents_of(left, docs, facts).dropDuplicates(["node"]))
        _rest(texts, classes, lambda pairs: add(pairs, lambda nodes: _texts_among(texts, nodes)), words, percent)
    return links, documents


def _classes(docs: DataFrame, links: list[DataFrame]) -> DataFrame:
    if not links:
        return docs.sparkSession.createDataFrame([], "node bigint, component bigint")
    return components(reduce(DataFrame.union, links))


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Documents link when 100 * intersection >= percent * union of their sets of distinct n-grams of ``words`` words
    (lower-cased A-Z, split at ASCII white space); component_id is the smallest doc_id that links reach.

    Edge cases: a text with fewer words is one n-gram as a whole; a null or empty text has none and links with
    nothing, its component is its own id. Repeated rows count as copies of each other; a row without doc_id keeps a
    null component and lends none. An empty table gives an empty result. Other columns are ignored.
    """
    links, documents = jaccard_links(docs, words, percent)
    classed = documents.join(_classes(docs, links), "node", "left").select("doc_id", "size", F.coalesce("component", "node").alias("class"))
    filled = cut_lineage(classed.filter("size > 0"))
    smallest = filled.groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("key_rows"))
    joined = join_per_key(filled, smallest, ["class"], "doc_id", hot_floor=5_000)
    joined = joined.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return joined.union(classed.filter("size = 0").select("doc_id", F.col("size"), F.col("doc_id")))


def first_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class of ``jaccard_classes``: the smallest doc_id, then the smallest hash of the text.

    Rows are judged by doc_id and text together, so what shares an id with a copy stays. Edge cases: a row without
    doc_id comes after all others of its class; of rows with the same id and text one stays; texts without words all
    stay. An empty table gives an empty result; other columns pass through, whatever their names.
    """
    links, documents = jaccard_links(docs, words, percent)
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash").alias("key")
    classed = documents.join(_classes(docs, links), "node", "left").filter("size > 0")
    classed = cut_lineage(classed.select("doc_id", F.coalesce("component", "node").alias("class"), key))
    first = classed.groupBy("class").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("key_rows"))
    judged = cut_lineage(join_per_key(classed, first, ["class"], "doc_id", hot_floor=5_000).select("key", (F.col("key") == F.col("first")).alias("stays")))
    gone = cut_lineage(judged.filter("NOT stays").select("key").distinct())
    again = cut_lineage(judged.filter("stays").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    own = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64("text").alias("text_hash")).alias("key")
    left = docs.select(F.struct("*").alias("row"), own).join(gone, "key", "left_anti")
    once = left.join(again, "key", "left_anti").union(left.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return once.select("row.*")
