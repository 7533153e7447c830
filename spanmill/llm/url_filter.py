"""URLs accepted or blocked by rules, and where no rule fits by two character language models. DataFrame functions only.

Both models are variable-order Markov models over 32 symbols: letters, one for digits, ``/ . -``, one for all else, and
one for both ends. The probability of a symbol is that after its last three symbols, smoothed by the one after its last
two, and so on down to the even distribution (Witten-Bell): a context weighs as much as it has been seen, against the
number of different symbols seen after it; contexts never seen leave the shorter one as it is. One model counts all URLs
that rules allow, the other all that rules block; every such row of the table counts.

32 symbols and contexts of three make 2**20 cases whatever the input, so the differences of the two models' log
probabilities are one array of some 5 MB. A URL is scored by walking it once: nothing is shuffled for it.

The threshold is calibrated on the part of the decided URLs (by hash of the URL) that the models did not count: the
score for a symbol at which the share of allowed URLs below and of blocked URLs at or above it are least together.
Scores are whole numbers of micro-nats, so that sums and comparisons are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.session import cut_lineage

#: (verdict, host, path) as given.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The symbols in the order of their codes; the one after the last is both the start and the end.
SYMBOLS = LOWER + "0/.-~"
BITS, ORDER = 5, 3
END = 31
START = (END << 2 * BITS) | (END << BITS) | END
CASES = 1 << BITS * (ORDER + 1)
#: URLs whose md5 begins with one of these hexadecimal digits are left to the calibration.
HELD = "cdef"
MICRO = 1_000_000
#: Thresholds are multiples of this many micro-nats, up to ``REACH`` of them on either side.
STEP, REACH = 10_000, 500


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased; empty if there is no ``://``."""
    # (?s) and \z: a line break belongs to the URL like any other character.
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none), as ``host/path``, and its verdict."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, domain, start in reversed(longest):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(domain + start)).otherwise(rule), F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def canonical(url: Column) -> Column:
    """The URL behind ``://`` (all of it if there is none) in the models' symbols."""
    text = F.coalesce(F.translate(url, UPPER, LOWER), F.lit(""))
    text = F.regexp_replace(text, r"(?s)\A.*?://", "")
    return F.regexp_replace(F.translate(text, "123456789_", "000000000-"), f"[^{LOWER}0/.\\-]", "~")


def codes(text: Column) -> Column:
    """Codes of the symbols of a canonical text and the end behind them."""
    one = lambda c: (F.instr(F.lit(SYMBOLS), c) - 1).cast("int")
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.concat(F.transform(letters, one), F.array(F.lit(END)))


def gram_counts(decided: DataFrame) -> DataFrame:
    """(case, allowed, blocked): how often every case stands in URLs of either verdict. ``decided`` has url and verdict.

    A case is a symbol behind its context of ``ORDER`` symbols, all as one number below ``CASES``.
    """
    padded = F.concat(F.array(*[F.lit(END)] * ORDER), codes(canonical(F.col("url"))))
    # A column of its own, so that its symbols are not looked up again for each position.
    rows = decided.select("verdict", padded.alias("padded"))

    def at(i: Column) -> Column:
        window = [F.get("padded", i + k) for k in range(ORDER + 1)]
        return reduce(lambda high, low: F.shiftleft(high, BITS).bitwiseOR(low), window)

    places = F.sequence(F.lit(0), F.size("padded") - ORDER - 1)
    seen = rows.select("verdict", F.explode(F.transform(places, at)).alias("case"))
    return seen.groupBy("case").agg(*[F.count_if(F.col("verdict") == v).alias(n) for v, n in (("allow", "allowed"), ("block", "blocked"))])


def _probabilities(counts: DataFrame, order: int) -> DataFrame:
    """(context, p_allowed, p_blocked): for every context of ``order`` symbols the probabilities of all symbols, by code."""
    contexts, symbols = 1 << BITS * order, 1 << BITS
    names = ("allowed", "blocked")
    symbol = F.col("case").bitwiseAND(symbols - 1)
    seen = counts.groupBy(F.shiftright("case", BITS).bitwiseAND(contexts - 1).alias("context")).agg(
        *[F.array(*[F.sum(F.when(symbol == code, F.col(c)).otherwise(0)) for code in range(symbols)]).alias(c) for c in names]
    )
    every = counts.sparkSession.range(contexts).select(F.col("id").cast("int").alias("context"))
    if order:
        shorter = _probabilities(counts, order - 1).withColumnRenamed("context", "shorter")
        every = every.withColumn("shorter", F.col("context").bitwiseAND((contexts >> BITS) - 1)).join(shorter, "shorter")
    else:
        every = every.withColumns({f"p_{c}": F.array_repeat(F.lit(1.0 / symbols), symbols) for c in names})
    totals = {}
    for c in names:
        totals[f"n_{c}"] = F.aggregate(c, F.lit(0).cast("long"), lambda sum_, n: sum_ + n)
        totals[f"t_{c}"] = F.size(F.filter(c, lambda n: n > 0))

    def smoothed(name: str) -> Column:
        n, t, base = F.col(f"n_{name}"), F.col(f"t_{name}"), F.col(f"p_{name}")
        own = F.zip_with(name, base, lambda count, p: (count + t * p) / (n + t))
        return F.when(n > 0, own).otherwise(base)

    return every.join(seen.withColumns(totals), "context", "left").select("context", *[smoothed(c).alias(f"p_{c}") for c in names])


def log_ratios(counts: DataFrame) -> DataFrame:
    """One row with ``ratios``: by context and symbol, log p_allowed - log p_blocked in micro-nats."""
    ratio = F.zip_with("p_allowed", "p_blocked", lambda a, b: F.round(MICRO * (F.ln(a) - F.ln(b))).cast("int"))
    # One entry for each possible context, however large the input.
    listed = F.array_sort(F.collect_list(F.struct("context", ratio.alias("ratios"))))
    return _probabilities(counts, ORDER).agg(listed.alias("listed")).select(F.col("listed.ratios").alias("ratios"))


def with_totals(urls: DataFrame, model: DataFrame) -> DataFrame:
    """``urls`` (url) with the sum of the ratios of each (``total``) and its number of symbols with the end (``symbols``).

    The array of ratios is a scalar subquery. It may not stand inside a function with a lambda, so it is a column first,
    used once; the optimizer merges the two projections, and no row ever holds the array.
    """
    symbols = codes(canonical(F.col("url")))
    start = F.struct(F.lit(START).alias("context"), F.lit(0).cast("long").alias("total"))

    def step(held: Column, code: Column) -> Column:
        after = F.shiftleft(held["context"], BITS).bitwiseOR(code).bitwiseAND((CASES >> BITS) - 1)
        return F.struct(after.alias("context"), (held["total"] + F.get(F.get("_ratios", held["context"]), code)).alias("total"))

    total = F.aggregate(symbols, start, step)["total"]
    return urls.withColumn("_ratios", model.scalar()).select(*urls.columns, total.alias("total"), F.size(symbols).alias("symbols"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row with ``threshold``, from the held decided URLs (verdict, total, symbols); 0 if one verdict has none."""
    place = F.floor(F.col("total") / (F.col("symbols") * STEP))
    bins = scored.select("verdict", F.greatest(F.least(place, F.lit(REACH)), F.lit(-REACH - 1)).alias("place"))
    bins = bins.groupBy("place").agg(F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    # At most 2 * REACH + 2 bins, and as many candidates as bins less one.
    listed = F.collect_list(F.struct("place", "allowed", "blocked"))

    def over(name: str, keep) -> Column:
        return F.aggregate("listed", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.when(keep(b["place"]), b[name]).otherwise(0))

    sums = bins.agg(listed.alias("listed"), F.sum("allowed").alias("n_allowed"), F.sum("blocked").alias("n_blocked"))
    candidates = sums.withColumn("at", F.explode(F.sequence(F.lit(-REACH), F.lit(REACH))))
    missed, passed = over("allowed", lambda p: p < F.col("at")), over("blocked", lambda p: p >= F.col("at"))
    # Both shares over one denominator, in whole numbers.
    wrong = missed.cast("decimal(19,0)") * F.col("n_blocked").cast("decimal(19,0)") + passed.cast("decimal(19,0)") * F.col("n_allowed").cast("decimal(19,0)")
    usable = candidates.filter((F.col("n_allowed") > 0) & (F.col("n_blocked") > 0))
    best = usable.agg(F.min_by("at", F.struct(wrong.alias("wrong"), F.abs("at").alias("size"), "at")).alias("at"))
    return best.select((F.coalesce("at", F.lit(0)) * STEP).cast("long").alias("threshold"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, total (micro-nats, allowed against blocked) and symbols of every row of ``pages`` (page_id, url).

    The verdict is that of the longest rule that fits host and path; else ``allow`` if the URL's log ratio for a symbol
    reaches the threshold, and ``block`` if not.

    Edge cases: a null URL, or one without ``://``, has an empty host and path, no rule, and is judged by the models (a
    null one as an empty text). URLs of any length are read whole. Repeated rows count and come back each; rows without
    page_id too. Rules of equal length go by their text. Where no URL of one verdict has been counted, that model is
    even; where one has none to calibrate with, the threshold is 0, and a score equal to the threshold is allowed. An
    empty table gives an empty result. Other columns are ignored.
    """
    url = F.col("url")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    parsed = parsed.withColumns({"rule": rule, "by_rule": verdict})
    decided = parsed.filter("by_rule IS NOT NULL").select("url", F.col("by_rule").alias("verdict"))
    held = F.substring(F.md5(url.cast("binary")), 1, 1).isin(*HELD)
    model = cut_lineage(log_ratios(gram_counts(decided.filter(~held))))
    bound = cut_lineage(threshold(with_totals(decided.filter(held), model))).scalar()
    judged = with_totals(parsed, model)
    accepted = F.when(F.col("total") >= F.col("symbols") * bound, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", accepted).alias("verdict"), "total", "symbols")
