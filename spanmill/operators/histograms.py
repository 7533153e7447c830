"""Counts of vector entries by group, dimension and bin, without a row for each entry.

Tasks keep minima, maxima and counts as arrays and add to them batch by batch (Arrow); what leaves a task is one row for
each (group, piece of ``CHUNK`` dimensions). Rows of one piece are then folded in the order of their key, one at a time.

The ranges of all groups are needed to count. Where they and the counts of a task fit into ``STATE_BYTES``, which is
checked, ranges are broadcast and every task counts all groups it meets. Beyond that vectors are dealt by group, behind
their group's range; a group of many rows is split, and its range repeated for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.session import cut_lineage

CHUNK = 64
#: What one task may hold of ranges or counts before it passes them on.
STATE_BYTES = 64 << 20
#: Rows of one group that stay together when vectors are dealt by group.
SPLIT_ROWS = 200_000

Batches = Iterator[pa.RecordBatch]


def _folded(parts: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """``parts`` (key, chunk, arrays) to one row per key and chunk; ``kinds`` says how each array folds, and its type."""
    schema = "key string, chunk int, " + ", ".join(f"{name} array<{kind}>" for name, (_, kind) in kinds.items())

    def run(batches: Batches) -> Batches:
        folds = {"min": np.minimum, "max": np.maximum, "sum": np.add}
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("key").to_pylist(), batch.column("chunk").to_pylist(), strict=True))
            begin = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
            done = []
            columns = {}
            for name, (fold, _) in kinds.items():
                column = batch.column(name)
                columns[name] = folds[fold].reduceat(column.flatten().to_numpy().reshape(batch.num_rows, -1), begin, axis=0)
            for i, at in enumerate(begin):
                arrays = {name: columns[name][i] for name in kinds}
                if held is not None and held[0] == keys[at]:
                    held = (keys[at], {name: folds[kinds[name][0]](held[1][name], arrays[name]) for name in kinds})
                    continue
                if held is not None:
                    done.append(held)
                held = (keys[at], arrays)
            if done:
                yield rows(done)
        if held is not None:
            yield rows([held])

    def rows(done: list) -> pa.RecordBatch:
        columns = [pa.array([k for (k, _), _ in done]), pa.array([c for (_, c), _ in done], pa.int32())]
        columns += [pa.array([arrays[name].tolist() for _, arrays in done]) for name in kinds]
        return pa.RecordBatch.from_arrays(columns, ["key", "chunk", *kinds])

    return parts.repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(run, schema)


def _ranges(rows: DataFrame) -> DataFrame:
    """(key, chunk, lows, highs, n) of ``rows`` (key, vector); ``n`` has one entry, the rows of the key."""
    chunk, most = CHUNK, STATE_BYTES

    def run(batches: Batches) -> Batches:
        held: dict = {}
        size = 0

        def out() -> pa.RecordBatch:
            keys, numbers, lows, highs, counts = [], [], [], [], []
            for key, (low, high, n) in held.items():
                for c in range(len(low) // chunk):
                    keys.append(key)
                    numbers.append(c)
                    lows.append(low[c * chunk : (c + 1) * chunk].tolist())
                    highs.append(high[c * chunk : (c + 1) * chunk].tolist())
                    counts.append([n])
            return pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(numbers, pa.int32()), pa.array(lows), pa.array(highs), pa.array(counts)], ["key", "chunk", "lows", "highs", "n"])

        for batch in batches:
            lengths = np.array([n or 0 for n in pa.compute.list_value_length(batch.column("vector")).to_pylist()])
            encoded = batch.column("key").dictionary_encode()
            codes, names = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
            for dims in np.unique(lengths[lengths > 0]).tolist():
                own = np.flatnonzero(lengths == dims)
                values = batch.column("vector").take(pa.array(own)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
                order = np.argsort(codes[own], kind="stable")
                sorted_codes = codes[own][order]
                begin = np.flatnonzero(np.diff(sorted_codes, prepend=-1))
                counts = np.diff(np.append(begin, len(order)))
                lows, highs = np.fmin.reduceat(values[order], begin, axis=0), np.fmax.reduceat(values[order], begin, axis=0)
                width = -(-dims // chunk) * chunk
                for code, low, high, n in zip(sorted_codes[begin].tolist(), lows, highs, counts.tolist(), strict=True):
                    # Dimensions without a value have an empty range.
                    low_, high_ = np.full(width, np.inf), np.full(width, -np.inf)
                    low_[:dims], high_[:dims] = np.where(np.isnan(low), np.inf, low), np.where(np.isnan(high), -np.inf, high)
                    if names[code] in held:
                        before = held[names[code]]
                        size -= 16 * len(before[0])
                        wide = max(width, len(before[0]))
                        low_, high_ = (np.concatenate([a, np.full(wide - len(a), e)]) for a, e in ((low_, np.inf), (high_, -np.inf)))
                        was_low, was_high = (np.concatenate([a, np.full(wide - len(a), e)]) for a, e in ((before[0], np.inf), (before[1], -np.inf)))
                        low_, high_, n = np.minimum(low_, was_low), np.maximum(high_, was_high), n + before[2]
                    held[names[code]] = (low_, high_, n)
                    size += 16 * len(low_)
            if size > most:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    parts = rows.select("key", "vector").mapInArrow(run, "key string, chunk int, lows array<double>, highs array<double>, n array<bigint>")
    return _folded(parts, {"lows": ("min", "double"), "highs": ("max", "double"), "n": ("sum", "bigint")})


def _counts(bins: int, known: dict | None):
    """Batches of (key, current, vector[, lows, highs]) to counts by (key, chunk).

    With ``known`` every key's range is there from the start, and all keys are held; without, a key's range comes as a row
    without a vector before its vectors, and one key is held.
    """
    chunk = CHUNK

    def run(batches: Batches) -> Batches:
        held: dict = {}
        ranges = known.value if known is not None else {}

        def out() -> pa.RecordBatch:
            keys, numbers, sides = [], [], ([], [])
            for key, counts in held.items():
                for c in range(counts.shape[1] // chunk):
                    keys.append(key)
                    numbers.append(c)
                    for side in (0, 1):
                        sides[side].append(counts[side, c * chunk : (c + 1) * chunk].ravel().tolist())
            kind = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(numbers, pa.int32()), pa.array(sides[0], kind), pa.array(sides[1], kind)], ["key", "chunk", "baseline", "current"])

        for batch in batches:
            names = batch.column("key").to_pylist()
            begin = [i for i, k in enumerate(names) if not i or k != names[i - 1]] if known is None else [0]
            for first, last in zip(begin, [*begin[1:], len(names)], strict=True):
                part = batch.slice(first, last - first)
                if known is None:
                    marks = np.flatnonzero(part.column("vector").is_null().to_numpy(zero_copy_only=False))
                    if names[first] not in ranges:
                        if held:
                            yield out()
                        at = int(marks[0])
                        ranges = {names[first]: (np.array(part.column("lows")[at].as_py()), np.array(part.column("highs")[at].as_py()))}
                        held = {}
                add(part, held, ranges)
        if held:
            yield out()

    def add(part: pa.RecordBatch, held: dict, ranges: dict) -> None:
        lengths = np.array([n or 0 for n in pa.compute.list_value_length(part.column("vector")).to_pylist()])
        encoded = part.column("key").dictionary_encode()
        codes, names = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
        current = part.column("current").to_numpy(zero_copy_only=False).astype(np.int64)
        for dims in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == dims)
            values = part.column("vector").take(pa.array(own)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
            for code in np.unique(codes[own]).tolist():
                mine = codes[own] == code
                low, high = ranges[names[code]]
                width = len(low)
                v = values[mine]
                gap = high[:dims] - low[:dims]
                with np.errstate(invalid="ignore", divide="ignore"):
                    place = np.where(gap > 0, np.floor((v - low[:dims]) / gap * bins), 0.0)
                usable = ~np.isnan(v)
                place = np.clip(np.where(usable, place, 0), 0, bins - 1).astype(np.int64)
                flat = (current[own][mine][:, None] * width + np.arange(dims)) * bins + place
                found = np.bincount(flat[usable], minlength=2 * width * bins).reshape(2, width, bins)
                held[names[code]] = held[names[code]] + found if names[code] in held else found

    return run


def dim_counts(vectors: DataFrame, vector: str, side: str, group: list[str], bins: int) -> DataFrame:
    """(group, dim, range_width, baseline, current): counts by bin of every dimension that has values.

    Equal bins over the joint range of both sides, the last one closed; a constant dimension has all in the first.
    Null, NaN and missing entries are not counted; vectors of a group may differ in length.
    """
    spark = vectors.sparkSession
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit("")
    current = F.when(F.col(side) == "current", 1).when(F.col(side) == "baseline", 0)
    rows = vectors.select(key.alias("key"), current.alias("current"), F.col(vector).alias("vector")).filter("current IS NOT NULL AND size(vector) > 0")
    ranges = cut_lineage(_ranges(rows))
    pieces = ranges.count()
    schema = "key string, chunk int, baseline array<bigint>, current array<bigint>"
    if pieces * CHUNK * 16 * (bins + 1) <= STATE_BYTES:
        known: dict = {}
        for r in ranges.orderBy("key", "chunk").collect():
            low, high = known.get(r["key"], (np.zeros(0), np.zeros(0)))
            known[r["key"]] = (np.append(low, r["lows"]), np.append(high, r["highs"]))
        parts = rows.mapInArrow(_counts(bins, spark.sparkContext.broadcast(known)), schema)
    else:
        parts = _dealt(rows, ranges).mapInArrow(_counts(bins, None), schema)
    folded = _folded(parts, {"baseline": ("sum", "bigint"), "current": ("sum", "bigint")}).join(ranges, ["key", "chunk"])

    def of_dim(name: str):
        return F.slice(name, F.col("at") * bins + 1, F.lit(bins)).alias(name)

    unfolded = folded.select("*", F.explode(F.sequence(F.lit(0), F.lit(CHUNK - 1))).alias("at"))
    unfolded = unfolded.filter(F.get("lows", F.col("at")) <= F.get("highs", F.col("at")))
    back = [F.from_json("key", vectors.select(*group).schema).alias("_group")] if group else []
    found = unfolded.select(
        *back, (F.col("chunk") * CHUNK + F.col("at")).alias("dim"), (F.get("highs", F.col("at")) - F.get("lows", F.col("at"))).alias("range_width"), of_dim("baseline"), of_dim("current"))
    return found.select(*[F.col("_group")[g].alias(g) for g in group], "dim", "range_width", "baseline", "current")


def _dealt(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Vectors in the order of their group, each group behind a row with its range; groups of many rows in several parts."""
    whole = ranges.groupBy("key").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "lows"))), lambda c: c["lows"])).alias("lows"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "highs"))), lambda c: c["highs"])).alias("highs"),
        F.max(F.get("n", F.lit(0))).alias("n"),
    )
    splits = F.ceil(F.col("n") / SPLIT_ROWS).cast("int")
    # Fewer keys than rows / SPLIT_ROWS.
    large = whole.select("key", splits.alias("splits")).filter("splits > 1")
    salted = rows.join(F.broadcast(large), "key", "left").withColumn("salt", F.when(F.col("splits").isNotNull(), F.floor(F.rand(7) * F.col("splits")).cast("int")).otherwise(0))
    vectors = salted.select("key", "salt", F.lit(1).alias("kind"), "current", "vector", F.lit(None).cast("array<double>").alias("lows"), F.lit(None).cast("array<double>").alias("highs"))
    heads = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), splits - 1))).select(
        "key", "salt", F.lit(0).alias("kind"), F.lit(0).alias("current"), F.lit(None).cast(rows.schema["vector"].dataType).alias("vector"), "lows", "highs")
    both = heads.union(vectors).repartition("key", "salt").sortWithinPartitions("key", "salt", "kind")
    return both.select("key", "current", "vector", "lows", "highs")
