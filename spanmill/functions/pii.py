"""Personal-data patterns as array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanmill.functions.text import let

# Item types in output order, with their patterns.
PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
}
ITEM_WEIGHT = 0.3
THRESHOLD = 0.5
TEXT_LIMIT = 500  # of a shortened text, see ``labels.short``

# Card numbers are a documented type without a pattern; this one is ours.
CARD_PATTERN = r"\b[0-9]{13,16}\b"

# Java word breaks and digits are ASCII unless told otherwise.
_UNICODE = "(?U)"


def _tagged(kind: str):
    # A factory, because a default argument would turn the lambda into its (item, index) form.
    def to_item(value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias("value"))

    return to_item


def _matches(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(_UNICODE + pattern), F.lit(0))
    if "@" in pattern:
        # A plain substring search spares most texts the costliest pattern.
        return F.when(text.contains("@"), found).otherwise(F.array().cast("array<string>"))
    return found


def luhn_valid(number: Column) -> Column:
    """Luhn check of a digit string: every second digit from the right is doubled."""
    digits = F.transform(F.split(F.reverse(number), ""), lambda c: c.cast("int"))
    folded = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)),
    )
    return F.aggregate(folded, F.lit(0), lambda acc, d: acc + d) % 10 == 0


def card_numbers(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(_matches(F.coalesce(text, F.lit("")), CARD_PATTERN), luhn_valid)


def pii_items(text: str | Column, cards: bool = False) -> Column:
    """All matches as ``array<struct<type,value>>``, by type, repeats kept."""
    text = F.col(text) if isinstance(text, str) else text
    text = F.coalesce(text, F.lit(""))
    parts = [F.transform(_matches(text, p), _tagged(kind)) for kind, p in PATTERNS.items()]
    if cards:
        parts.append(F.transform(card_numbers(text), _tagged("credit_card")))
    return F.concat(*parts)


def pii_score(items: Column) -> Column:
    return F.least(F.size(items) * F.lit(ITEM_WEIGHT), F.lit(1.0))


def pii_reason(items: Column) -> Column:
    found = F.concat(F.lit("Found "), F.size(items).cast("string"), F.lit(" PII items"))
    return F.when(F.size(items) > 0, found).otherwise("No PII detected")


def needs_triage(items: Column, threshold: float = THRESHOLD, always_flag: tuple[str, ...] = ()) -> Column:
    """Detected and scored high enough; listed types can be flagged whatever their score."""
    flagged = (F.size(items) > 0) & (pii_score(items) >= threshold)
    if always_flag:
        flagged = flagged | F.exists(items, lambda i: i["type"].isin(*always_flag))
    return flagged


# ---- masking ----

_END_BITS = 32
_END_MASK = (1 << _END_BITS) - 1


def _ranges(text: Column, pattern: str) -> Column:
    """Start and end of every match, counted in characters from 0, as one long: start in the upper half, end in the lower.

    What lies between the matches and the matches themselves alternate, so their lengths add up to the positions.
    """
    between = F.transform(F.split(text, _UNICODE + pattern, -1), lambda t: F.length(t))
    found = F.transform(F.regexp_extract_all(text, F.lit(_UNICODE + pattern), F.lit(0)), lambda t: F.length(t))
    # split() gives one part more than there are matches.
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(held: Column, s: Column) -> Column:
        begin, end = held["at"] + s["gap"], held["at"] + s["gap"] + s["size"]
        packed = F.shiftleft(begin, _END_BITS).bitwiseOR(end)
        return F.struct(end.alias("at"), F.concat(held["out"], F.array(packed)).alias("out"))

    return F.aggregate(steps, start, step)["out"]


def merged_ranges(ranges: Column) -> Column:
    """Ranges (packed longs) that overlap or touch as maximal runs, in order."""
    start = F.struct(F.lit(None).cast("bigint").alias("open"), F.array().cast("array<bigint>").alias("out"))

    def step(held: Column, r: Column) -> Column:
        begin, end = F.shiftright(r, _END_BITS), r.bitwiseAND(_END_MASK)
        open_begin, open_end = F.shiftright(held["open"], _END_BITS), held["open"].bitwiseAND(_END_MASK)
        grows = held["open"].isNotNull() & (begin <= open_end)
        longer = F.shiftleft(open_begin, _END_BITS).bitwiseOR(F.greatest(open_end, end))
        closed = F.when(held["open"].isNull(), held["out"]).otherwise(F.concat(held["out"], F.array(held["open"])))
        return F.struct(F.when(grows, longer).otherwise(r).alias("open"), F.when(grows, held["out"]).otherwise(closed).alias("out"))

    def close(held: Column) -> Column:
        return F.when(held["open"].isNull(), held["out"]).otherwise(F.concat(held["out"], F.array(held["open"])))

    return F.aggregate(F.array_sort(ranges), start, step, close)


def masked(text: Column, runs: Column, mask: str = "*") -> Column:
    """``text`` with the characters of every run replaced by as many ``mask`` characters."""

    def cut(begin: Column, end: Column) -> Column:
        return F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))

    def piece(run: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(runs, i - 1).bitwiseAND(_END_MASK)).otherwise(0)
        begin, end = F.shiftright(run, _END_BITS), run.bitwiseAND(_END_MASK)
        return F.concat(cut(before, begin), F.repeat(F.lit(mask), (end - begin).cast("int")))

    rest = cut(F.element_at(runs, -1).bitwiseAND(_END_MASK), F.length(text))
    return F.when(F.size(runs) > 0, F.concat(F.array_join(F.transform(runs, piece), ""), rest)).otherwise(text)


def pii_runs(text: str | Column, cards: bool = False) -> Column:
    """The maximal runs of characters that any pattern matches, as packed longs."""
    text = F.col(text) if isinstance(text, str) else text
    patterns = [*PATTERNS.values(), *([CARD_PATTERN] if cards else [])]
    found = []
    for pattern in patterns:
        ranges = _ranges(text, pattern)
        if pattern == CARD_PATTERN:
            valid = F.transform(F.regexp_extract_all(text, F.lit(_UNICODE + pattern), F.lit(0)), luhn_valid)
            ranges = F.filter(F.zip_with(ranges, valid, lambda r, ok: F.when(ok, r)), lambda r: r.isNotNull())
        if "@" in pattern:
            ranges = F.when(text.contains("@"), ranges).otherwise(F.array().cast("array<bigint>"))
        found.append(ranges)
    return merged_ranges(F.concat(*found))


def has_pii(text: str | Column, cards: bool = False) -> Column:
    """Whether any pattern matches."""
    text = F.col(text) if isinstance(text, str) else text
    patterns = [*PATTERNS.values(), *([CARD_PATTERN] if cards else [])]
    tests = [text.contains("@") & text.rlike(_UNICODE + p) if "@" in p else text.rlike(_UNICODE + p) for p in patterns]
    return reduce(lambda a, b: a | b, tests)


def masked_words(text: str | Column, cards: bool = False, mask: str = "*") -> Column:
    """The words of ``text``, each with the white space behind it, as ``array<struct<text,runs>>``: masked, and its number of runs.

    No pattern matches white space, and white space ends a word wherever it stands, so words are judged one by one with
    the same result; positions are then taken within a word, and the cost grows with the text.
    """
    text = F.col(text) if isinstance(text, str) else text

    def judge(word: Column) -> Column:
        clean = F.struct(word.alias("text"), F.lit(0).alias("runs"))
        runs = let(pii_runs(word, cards), lambda r: F.struct(masked(word, r, mask).alias("text"), F.size(r).alias("runs")))
        return F.when(has_pii(word, cards), runs).otherwise(clean)

    return F.transform(F.split(text, r"(?<=\s)"), judge)
