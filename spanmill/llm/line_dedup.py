"""Near-duplicate lines by segment partition, with DataFrame functions only.

Two lines within ``max_edits`` edits agree in at least one of ``max_edits + 1`` segments of the shorter line, at a
place that may be shifted by few characters. Every distinct line therefore indexes its own segments under its length,
and probes the substrings that could match segments of lines up to ``max_edits`` shorter. Signatures that more than
``FEW`` lines share are not paired: with one edit, the stretch that still differs is halved (one half must agree
again) until few lines are left together or the stretch is a single character. Candidates are verified with a banded
bit-parallel automaton: one small integer for each number of errors, one bit for each diagonal.

A line is removed if the same line, or a line within the bound, stands earlier (smaller doc_id, then smaller line
number), so the first of its kind stays. A document is known by doc_id and the hash of its text, so that rows may share
an id; the hash then says which of them is earlier. Lines shorter than ``min_chars`` always stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.llm.jaccard import PRUNED
from spanmill.operators.skew import join_per_key
from spanmill.session import counted_copy, cut_lineage, settings

MAX_EDITS, MIN_CHARS = 1, 20
#: Lines that share a signature are paired up to this many; more are told apart by longer signatures first.
FEW = 16
_LAST = 9223372036854775807


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(place, text_hash, no, line, x, y): the lines that count, by document and number, with a 128-bit hash."""
    split = docs.select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("place"), F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "line"),
    )
    return split.filter(F.char_length("line") >= min_chars).select(
        "place", "text_hash", "no", "line", F.xxhash64("line").alias("x"), F.xxhash64(F.lit(1), "line").alias("y")
    )


def _signature(short: Column, start: Column, end: Column, text: Column) -> Column:
    """``text`` as what stands at [start, end) of a line of ``short`` characters."""
    return F.xxhash64(short, start, end, text)


def _probes(max_edits: int) -> list[Column]:
    """(signature, own, head, tail) of every own segment and every substring to probe; see ``_narrowed`` for the last two."""
    line, size, parts = F.col("line"), F.char_length("line"), max_edits + 1
    found = []
    for shorter in range(max_edits + 1):
        short = size - shorter
        for i in range(parts):
            begin, end = F.floor(short * i / parts), F.floor(short * (i + 1) / parts)
            low, high = max(-i, shorter - (max_edits - i)), min(i, shorter + max_edits - i)
            for shift in range(low, high + 1):
                piece = F.substring(line, begin + shift + 1, end - begin)
                head, tail = (end, F.lit(0)) if i == 0 else (F.lit(0), short - begin)
                found.append(F.struct(
                    _signature(short, begin, end, piece).alias("signature"), F.lit(shorter == 0 and shift == 0).alias("own"),
                    head.cast("int").alias("head"), tail.cast("int").alias("tail"), short.cast("int").alias("short"),
                ))
    return found


def within(short: Column, long: Column, max_edits: int) -> Column:
    """Whether two strings are at most ``max_edits`` edits apart; ``long`` is at most that much longer than ``short``.

    ``state[e]`` has a bit for each diagonal that the automaton can be on after e errors; a character of ``short``
    moves all of them at once.
    """
    width = 2 * max_edits + 1
    pad = F.array(*[F.lit("")] * max_edits)
    # Bound once for all steps: an expression inside a lambda would be computed anew in each.
    letters = F.struct(F.split(short, "").alias("one"), F.concat(pad, F.split(long, ""), pad).alias("other"))
    start = F.struct(*(F.lit(sum(1 << (max_edits + j) for j in range(e + 1))).alias(f"e{e}") for e in range(max_edits + 1)))

    def run(both: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            letter = F.element_at(both["one"], i)
            same = reduce(
                lambda x, y: x.bitwiseOR(y),
                [F.when(F.element_at(both["other"], i + k) == letter, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)],
            )
            after = [state["e0"].bitwiseAND(same)]
            for e in range(1, max_edits + 1):
                before = state[f"e{e - 1}"]
                moved = state[f"e{e}"].bitwiseAND(same).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(after[-1], 1))
                after.append(moved.bitwiseAND(F.lit((1 << width) - 1)))
            return F.struct(*(c.alias(f"e{e}") for e, c in enumerate(after)))

        return F.aggregate(F.sequence(F.lit(1), F.size(both["one"])), start, step)[f"e{max_edits}"]

    final = F.call_function("shiftleft", F.lit(1), (F.char_length(long) - F.char_length(short) + max_edits).cast("int"))
    ended = F.element_at(F.transform(F.array(letters), run), 1)
    return F.when(F.char_length(short) == 0, F.lit(True)).otherwise(ended.bitwiseAND(final) > 0)


def _met(rows: DataFrame) -> DataFrame:
    """Pairs of lines, the shorter first, that share a signature which one of them has as its own segment."""
    one, two = rows.filter("own").alias("one"), rows.alias("two")
    ordered = (F.col("one.size") < F.col("two.size")) | (
        (F.col("one.size") == F.col("two.size")) & (F.struct("one.x", "one.y") < F.struct("two.x", "two.y"))
    )
    return one.join(two, (F.col("one.signature") == F.col("two.signature")) & ordered).select(
        F.col("one.x").alias("x1"), F.col("one.y").alias("y1"), F.col("two.x").alias("x2"), F.col("two.y").alias("y2")
    )


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` of signatures that a line's own segment and another line share, with the number of lines."""
    shared = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("lines"), F.count_if("own").alias("owns"))
    return rows.join(shared.filter("lines > 1 AND owns > 0").select("signature", "lines"), "signature")


def _narrowed(rows: DataFrame) -> DataFrame:
    """For lines that agree in the first ``head`` and last ``tail`` characters: one half more of what lies between.

    A single edit leaves one of the halves as it is, so a pair goes on under at least one of the two signatures.
    """
    rest = F.col("short") - F.col("head") - F.col("tail")
    half = F.floor(rest / 2).cast("int")
    longer = F.array(
        F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
        F.struct(F.col("head").alias("head"), (F.col("tail") + rest - half).alias("tail")),
    )
    spread = rows.select("x", "y", "size", "line", "own", "short", F.explode(longer).alias("kept")).select("x", "y", "size", "line", "own", "short", "kept.*")
    ends = F.concat(F.substring(F.col("line"), F.lit(1), F.col("head")), F.lit("\n"), F.substring(F.col("line"), F.col("size") - F.col("tail") + 1, F.col("tail")))
    return spread.withColumn("signature", _signature(F.col("short"), F.col("head"), F.col("tail"), ends)).distinct()


def similar_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """The distinct lines (x, y, place, times) and the links (x1, y1, x2, y2, later_x, later_y) between different ones.

    A link names the line of the two that appears later.
    """
    signed = _lines(docs, min_chars).withColumn("rows", F.array(*_probes(max_edits)))
    names = [f"s{i}" for i in range(len(_probes(max_edits)))]
    flat = signed.select("place", "x", "y", F.char_length("line").alias("size"), *(F.col("rows")[i]["signature"].alias(n) for i, n in enumerate(names)))
    distinct = cut_lineage(flat.groupBy("x", "y").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("times"), F.min("size").alias("size"), *(F.min(n).alias(n) for n in names)))
    owns = [i for i, p in enumerate(_own_flags(max_edits)) if p]
    rows = distinct.select("x", "y", "place", F.posexplode(F.array(*names)).alias("probe", "signature"))
    rows = rows.withColumn("own", F.col("probe").isin(owns))
    near = cut_lineage(_counted(rows).select("x", "y", "place", "probe", "lines"))
    # Texts of the lines that share a signature with another.
    wanted = cut_lineage(near.select("x", "y", "place").distinct())
    places = cut_lineage(wanted.select("place").distinct())
    with settings(docs.sparkSession, PRUNED):
        holding = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "text").join(places.filter(F.col("place") > -_LAST).withColumnRenamed("place", "doc_id"), "doc_id")
        texts = _lines(holding, min_chars).join(wanted, ["place", "x", "y"]).groupBy("x", "y").agg(F.min(F.struct("place", "text_hash", "no")).alias("stand"), F.first("line").alias("line"))
        texts = cut_lineage(texts)
    rebuilt = near.select("x", "y", "probe", "lines").join(texts.select("x", "y", "line"), ["x", "y"]).withColumn("row", F.array(*_probes(max_edits))[F.col("probe")])
    rows = cut_lineage(rebuilt.select("x", "y", F.char_length("line").alias("size"), "line", "lines", "row.*"))
    few = FEW if max_edits == 1 else 1 << 62
    pairs = _met(rows.filter(F.col("lines") <= few))
    busy, left, _ = counted_copy(rows.filter(F.col("lines") > few).drop("lines"), F.lit(False))
    while left:
        rows = cut_lineage(_counted(_narrowed(busy)))
        done = (F.col("lines") <= few) | (F.col("short") - F.col("head") - F.col("tail") <= 1)
        pairs = pairs.union(_met(rows.filter(done)))
        busy, left, _ = counted_copy(rows.filter(~done).drop("lines"), F.lit(False))
    pairs = cut_lineage(pairs.distinct())
    for k in "12":
        pairs = pairs.join(texts.select(F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("stand", "line"))), [f"x{k}", f"y{k}"])
    close = (F.char_length("line2") - F.char_length("line1") <= max_edits) & within(F.col("line1"), F.col("line2"), max_edits)
    second = F.col("stand1") < F.col("stand2")
    later = [F.when(second, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(f"later_{c}") for c in "xy"]
    return distinct.select("x", "y", "place", "times"), cut_lineage(pairs.filter(close).select("x1", "y1", "x2", "y2", *later))


def _own_flags(max_edits: int) -> list[bool]:
    """Which of ``_probes`` are a line's own segments."""
    flags = []
    for shorter in range(max_edits + 1):
        for i in range(max_edits + 1):
            low, high = max(-i, shorter - (max_edits - i)), min(i, shorter + max_edits - i)
            flags += [shorter == 0 and shift == 0 for shift in range(low, high + 1)]
    return flags


def removed_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(place, text_hash, removed, n_near): for documents that lose lines, their sorted numbers, and how many went for a similar line only."""
    distinct, links = similar_lines(docs, max_edits, min_chars)
    later = links.select(F.col("later_x").alias("x"), F.col("later_y").alias("y")).distinct().withColumn("near", F.lit(True))
    known = distinct.join(later, ["x", "y"], "left").filter("times > 1 OR near")
    known = cut_lineage(known.select("x", "y", F.col("place").alias("first_place"), F.coalesce("near", F.lit(False)).alias("near")))
    met = _lines(docs, min_chars).select("place", "text_hash", "no", "x", "y").join(known, ["x", "y"])
    met = cut_lineage(met.withColumn("own", F.col("place") == F.col("first_place")).drop("first_place"))
    # A line may stand several times under the id that has it first: in one document, or in several that share the id.
    own = met.filter("own")
    firsts = own.groupBy("x", "y").agg(F.min(F.struct("text_hash", "no")).alias("first"), F.count(F.lit(1)).alias("key_rows"))
    own = join_per_key(own, cut_lineage(firsts), ["x", "y"], "text_hash", hot_floor=5_000)
    own = own.withColumn("is_first", F.struct("text_hash", "no") == F.col("first"))
    kept = ["place", "text_hash", "no", "near", "is_first"]
    gone = met.filter("NOT own").withColumn("is_first", F.lit(False)).select(kept).union(own.filter("near OR NOT is_first").select(kept))
    only_near = F.collect_set(F.when(F.col("near") & F.col("is_first"), F.col("no")))
    return gone.groupBy("place", "text_hash").agg(F.sort_array(F.collect_set("no")).alias("removed"), F.size(only_near).alias("n_near"))


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one; same columns, ``text`` shortened, the other lines untouched.

    Edge cases: a null text stays null and an empty text empty; rows without doc_id count as the last documents; rows
    with the same doc_id and text are one document and lose the same lines, different texts with one doc_id each their
    own. Very long texts and lines are taken whole. Documents that lose all
    lines stay with an empty text. An empty table gives an empty result; other columns pass through, whatever their names.
    """
    removed = cut_lineage(removed_lines(docs, max_edits, min_chars)).select("place", "text_hash", "removed")
    lines = F.split("row.text", "\n")
    marks = F.concat(F.array(F.lit(-1)), F.col("removed"), F.array(F.size(lines)))
    kept = F.flatten(F.transform(
        F.sequence(F.lit(1), F.size("removed") + 1),
        lambda j: F.slice(lines, F.element_at(marks, j) + 2, F.element_at(marks, j + 1) - F.element_at(marks, j) - 1),
    ))
    # The row is one column here, so that no name of its own can meet ours.
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(_LAST)).alias("place"), F.xxhash64("text").alias("text_hash"))
    joined = rows.join(removed, ["place", "text_hash"], "left")
    text = F.when(F.col("removed").isNull() | F.col("row.text").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def line_report(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near and ``removed`` (line numbers, comma-joined) of every row of ``docs``."""
    removed = removed_lines(docs, max_edits, min_chars)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("place"), F.xxhash64("text").alias("text_hash"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    joined = rows.join(removed, ["place", "text_hash"], "left")
    return joined.select(
        "doc_id", "n_lines",
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.array_join(F.transform("removed", lambda n: n.cast("string")), ","), F.lit("")).alias("removed"),
    )
