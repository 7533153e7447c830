"""Alert rules as rows over signal tables, and what becomes of their firings.

A signal is a table (signal, series, tick, value) on a fixed step; a rule names a signal,
a comparison and how long it must hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanmill.functions import times
from spanmill.functions.labels import PSI_CRITICAL, PSI_WARNING
from spanmill.operators.evals import passed
from spanmill.operators.metrics import INFINITY, bound_label, histogram_quantile
from spanmill.operators.series import sliding_ratio, sustained, to_ticks, trailing
from spanmill.session import cut_lineage

STEP_SECONDS = 15
RESOLVE_SECONDS = 300
LATENCY_BOUNDS = (0.5, 1.0, 1.5, 2.0, 2.5, 5.0, 10.0)

RULE_COLUMNS = "alert_name, severity, signal, comparator, threshold, step_seconds, for_seconds, description"
# Name, severity, signal, comparison, threshold, step and hold in seconds, text.
RULES = [
    ("HighErrorRate", "critical", "error_ratio", ">", 0.05, 15, 300, "Error rate above 5%"),
    ("HighLatency", "warning", "latency_p95", ">", 2.0, 15, 300, "P95 latency above 2s"),
    ("LowEvalPassRate", "warning", "eval_pass_ratio", "<", 0.8, 15, 600, "Eval pass rate below 80%"),
]
DAY = 86_400
PLAN_RULES = [
    ("LowFaithfulness", "warning", "faithfulness", "<", 0.6, DAY, 0, "Faithfulness below 0.6"),
    ("LowHallucinationScore", "warning", "hallucination", "<", 0.5, DAY, 0, "Hallucination score below 0.5"),
    ("VeryHighLatency", "critical", "latency_p95_daily", ">", 10.0, DAY, 0, "P95 latency above 10s"),
    ("EmbeddingDrift", "warning", "psi", ">", 0.2, DAY, 0, "PSI above 0.2"),
    ("DailyBudget", "warning", "daily_cost", ">", 100.0, DAY, 0, "Cost above 100 USD per day"),
]
# Seconds before a group's first notice by severity, hours between repeats.
GROUP_WAIT = {"critical": 10}
DEFAULT_WAIT = 30
REPEAT_HOURS = 4
#: Firings are merged into episodes within slots of this length first.
SLOT_SECONDS = 600


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """Rules as a VALUES relation; its size is known, so joins with it are broadcasts."""
    rows = ", ".join(
        f"('{n}', '{sev}', '{sig}', '{op}', {float(th)!r}D, {step}L, {hold}L, '{text}')"
        for n, sev, sig, op, th, step, hold, text in rules
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({RULE_COLUMNS})")


def as_signal(df: DataFrame, name: str, series: Column | None = None) -> DataFrame:
    series = F.lit("all") if series is None else series
    return df.select(F.lit(name).alias("signal"), series.alias("series"), "tick", F.col("value").cast("double").alias("value"))


def union_signals(*signals: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, signals)


# ---- signals ----

def error_ratio(spans: DataFrame, keys: list[str], step_seconds: int = STEP_SECONDS, width_seconds: int = 300) -> DataFrame:
    """Share of ERROR spans in the trailing 5 minutes."""
    errors = (F.col("status_code") == "ERROR").cast("long")
    return sliding_ratio(spans, "start_time", keys, errors, F.lit(1).cast("long"), step_seconds, width_seconds)


def latency_p95(
    spans: DataFrame, keys: list[str], step_seconds: int = STEP_SECONDS, width_seconds: int = 300,
    bounds: tuple[float, ...] = LATENCY_BOUNDS, p: float = 0.95,
) -> DataFrame:
    """p95 in seconds over the trailing 5 minutes, from cumulative buckets per tick."""
    seconds = F.col("duration_ms") / 1000
    names = [f"_b{i}" for i in range(len(bounds))] + ["_all"]
    counters = {f"_b{i}": (seconds <= b).cast("long") for i, b in enumerate(bounds)}
    counters["_all"] = F.lit(1).cast("long")
    ticks = to_ticks(spans, "start_time", keys, step_seconds, **counters)
    sums = trailing(ticks, keys, step_seconds, width_seconds, names)
    labels = [bound_label(b) for b in bounds] + [INFINITY]
    buckets = sums.select(
        *keys, "tick",
        F.inline(F.array(*[
            F.struct(F.lit(label).alias("le"), F.col(name).alias("bucket_count"))
            for label, name in zip(labels, names)
        ])),
    )
    return histogram_quantile(buckets, [*keys, "tick"], p, "value")


def eval_pass_ratio(evals: DataFrame, keys: list[str], step_seconds: int = STEP_SECONDS, width_seconds: int = 600) -> DataFrame:
    """Share of passing scores in the trailing 10 minutes, among metrics with a threshold."""
    judged = evals.withColumn("_passed", passed()).filter(F.col("_passed").isNotNull())
    return sliding_ratio(
        judged, "evaluated_at", keys, F.col("_passed").cast("long"), F.lit(1).cast("long"), step_seconds, width_seconds
    )


def daily_average(df: DataFrame, ts: str, value: Column, keys: list[str]) -> DataFrame:
    """Average per day as a signal with a step of one day."""
    return df.groupBy(*keys, times.tick_of(ts, DAY).alias("tick")).agg(F.avg(value).alias("value"))


def daily_sum(df: DataFrame, ts: str, value: Column, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, times.tick_of(ts, DAY).alias("tick")).agg(F.sum(value).alias("value"))


# ---- evaluation ----

def breached() -> Column:
    """The rule's comparison; a missing value breaches nothing."""
    value, bound = F.col("value"), F.col("threshold")
    return F.coalesce(
        F.when(F.col("comparator") == ">", value > bound).when(F.col("comparator") == "<", value < bound),
        F.lit(False),
    )


def evaluate_rules(signals: DataFrame, rules: DataFrame, as_of, since=None) -> DataFrame:
    """Stretches on which a rule's condition held, with when it fired and resolved.

    Samples after ``as_of`` are not known yet, and those before ``since`` are left out.

    It resolves at the next sample, or 5 minutes after the last one if the series falls
    silent; still open at ``as_of`` means no resolution.
    """
    signals = signals.filter(F.col("tick") <= F.unix_seconds(times.moment(as_of)))
    if since is not None:
        signals = signals.filter(F.col("tick") >= F.unix_seconds(times.moment(since)))
    joined = signals.join(rules, "signal")
    keys = ["alert_name", "severity", "description", "series"]
    found = sustained(joined, keys, F.col("step_seconds"), F.col("for_seconds"), breached())
    end = F.unix_seconds(times.moment(as_of))
    next_sample = F.col("next_tick") == F.col("end_tick") + F.col("step_seconds")
    over = F.when(next_sample, F.col("next_tick")).otherwise(F.col("end_tick") + RESOLVE_SECONDS)
    return found.select(
        *keys,
        F.timestamp_seconds("start_tick").alias("started_at"),
        F.timestamp_seconds("end_tick").alias("last_breach_at"),
        "ticks", "fired",
        F.timestamp_seconds("fired_tick").alias("fired_at"),
        F.when(F.col("fired") & (over < end), F.timestamp_seconds(over)).alias("resolved_at"),
    )


def high_error_rate(spans: DataFrame, as_of, keys: list[str] | None = None, step_seconds: int = STEP_SECONDS,
                    width_seconds: int = 300, for_seconds: int = 300, threshold: float = 0.05) -> DataFrame:
    name, severity, signal, op, _, _, _, text = RULES[0]
    return _single(
        error_ratio(spans, keys or [], step_seconds, width_seconds), keys, spans.sparkSession,
        (name, severity, signal, op, threshold, step_seconds, for_seconds, text), as_of,
    )


def high_latency(spans: DataFrame, as_of, keys: list[str] | None = None, step_seconds: int = STEP_SECONDS,
                 width_seconds: int = 300, for_seconds: int = 300, threshold: float = 2.0) -> DataFrame:
    name, severity, signal, op, _, _, _, text = RULES[1]
    return _single(
        latency_p95(spans, keys or [], step_seconds, width_seconds), keys, spans.sparkSession,
        (name, severity, signal, op, threshold, step_seconds, for_seconds, text), as_of,
    )


def low_eval_pass_rate(evals: DataFrame, as_of, keys: list[str] | None = None, step_seconds: int = STEP_SECONDS,
                       width_seconds: int = 600, for_seconds: int = 600, threshold: float = 0.8) -> DataFrame:
    name, severity, signal, op, _, _, _, text = RULES[2]
    return _single(
        eval_pass_ratio(evals, keys or [], step_seconds, width_seconds), keys, evals.sparkSession,
        (name, severity, signal, op, threshold, step_seconds, for_seconds, text), as_of,
    )


def _single(values: DataFrame, keys: list[str] | None, spark: SparkSession, rule: tuple, as_of) -> DataFrame:
    series = F.concat_ws("|", *keys) if keys else None
    return evaluate_rules(as_signal(values, rule[2], series), rule_table(spark, [rule]), as_of)


def target_down(heartbeats: DataFrame, as_of, target: str = "target", ts: str = "ts", silence_seconds: int = 120,
                step_seconds: int = STEP_SECONDS) -> DataFrame:
    """Silences of a target longer than ``silence_seconds``; an open one ends at ``as_of``.

    Heartbeats are first reduced to one row per (target, step), which loses no gap longer
    than a step, so the window sees steps instead of every heartbeat.
    """
    if silence_seconds < step_seconds:
        raise ValueError("the silence must not be shorter than the step")
    beats = heartbeats.groupBy(target, times.tick_of(ts, step_seconds).alias("_tick")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last")
    )
    following = F.lead("_first").over(W.partitionBy(target).orderBy("_tick"))
    gaps = beats.withColumn("_back", following).withColumn(
        "_until", F.coalesce("_back", times.moment(as_of))
    )
    silent = (F.unix_micros("_until") - F.unix_micros("_last")) / 1_000_000.0
    return gaps.withColumn("silent_seconds", silent).filter(F.col("silent_seconds") > silence_seconds).select(
        target, F.col("_last").alias("down_from"),
        (F.col("_last") + times.interval(seconds=silence_seconds)).alias("fired_at"),
        F.col("_back").alias("resolved_at"), "silent_seconds", F.lit("critical").alias("severity"),
    )


def drift_alerts(daily_psi: DataFrame) -> DataFrame:
    """Dates with an average PSI over 0.2 (warning) or 0.25 (critical)."""
    score = F.col("psi")
    return daily_psi.filter(score > PSI_WARNING).withColumn(
        "severity", F.when(score > PSI_CRITICAL, "critical").otherwise("warning")
    )


# ---- history and notices ----

def alert_history(intervals: DataFrame) -> DataFrame:
    """Rows of the history table for the stretches that fired."""
    return intervals.filter("fired").select(
        "alert_name", "severity",
        F.when(F.col("resolved_at").isNull(), "firing").otherwise("resolved").alias("status"),
        "description", "series", "fired_at", "resolved_at",
    )


def alert_timeline(history: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The firings, newest first, times as text; ``offset`` and ``limit`` give one page."""
    newest = history.orderBy(F.col("fired_at").desc(), "alert_name", "series").offset(offset)
    if limit is not None:
        newest = newest.limit(limit)
    return newest.select(
        F.col("alert_name").alias("name"), "severity", "status", "description", "series",
        times.format_ts("fired_at").alias("fired_at"), times.format_ts("resolved_at").alias("resolved_at"),
    )


def active_alerts(history: DataFrame) -> DataFrame:
    """Alerts without a resolution; blanks get their defaults."""
    def default(column: str, text: str) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(text))

    return history.filter(F.col("resolved_at").isNull()).select(
        default("alert_name", "Unknown").alias("name"),
        default("severity", "unknown").alias("severity"),
        default("status", "firing").alias("status"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.col("fired_at").alias("started_at"),
    )


def episodes(history: DataFrame, as_of, keys: list[str]) -> DataFrame:
    """(keys, started_at, ended_at, firings): unions of the overlapping firings of each key; open ones last until ``as_of``.

    Firings of one start become one row first, and windows run within slots of ``SLOT_SECONDS`` only; the latest end and
    the latest episode start of all earlier slots are carried over by windows with one row a slot. So an alert of very
    many firings is spread over its slots, and no task sees more than the start times of one. Firings without a start
    are left out; firings that touch are one episode.
    """
    slot = F.floor(F.unix_seconds("fired_at") / SLOT_SECONDS)
    starts = history.filter(F.col("fired_at").isNotNull()).groupBy(*keys, "fired_at").agg(
        F.max(F.coalesce("resolved_at", times.moment(as_of))).alias("_until"), F.count(F.lit(1)).alias("firings")
    )
    starts = cut_lineage(starts.withColumn("_slot", slot))
    within = W.partitionBy(*keys, "_slot").orderBy("fired_at")
    before, upto = within.rowsBetween(W.unboundedPreceding, -1), within.rowsBetween(W.unboundedPreceding, W.currentRow)
    slots = W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)

    def carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
        """``rows`` with the largest ``value`` of all earlier slots of their key."""
        ends = rows.groupBy(*keys, "_slot").agg(F.max(value).alias(name)).withColumn(name, F.max(name).over(slots)).alias("ends")
        same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"ends.{k}")) for k in (*keys, "_slot")]
        return rows.alias("rows").join(ends, same, "left").select("rows.*", name)

    marked = carried(starts, F.col("_until"), "_end").withColumn("_end", F.greatest("_end", F.max("_until").over(before)))
    opens = F.when(F.col("_end").isNull() | (F.col("fired_at") > F.col("_end")), F.col("fired_at"))
    marked = marked.withColumn("_opens", opens)
    placed = carried(marked, F.col("_opens"), "_open").withColumn("started_at", F.coalesce(F.max("_opens").over(upto), "_open"))
    return placed.groupBy(*keys, "started_at").agg(F.max("_until").alias("ended_at"), F.sum("firings").alias("firings"))


def group_notifications(history: DataFrame, as_of) -> DataFrame:
    """Notices per (alert, severity) group, as long as anything in the group fires.

    Overlapping firings form one episode. Its first notice goes out 30 s after the start
    (10 s when critical), the next every 4 hours.
    """
    group = ["alert_name", "severity"]
    wait = F.lit(DEFAULT_WAIT)
    for severity, seconds in GROUP_WAIT.items():
        wait = F.when(F.col("severity") == severity, seconds).otherwise(wait)
    first = F.col("started_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait)
    return (
        episodes(history, as_of, group).withColumn("_first", first)
        .filter(F.col("_first") <= F.col("ended_at"))
        .withColumn("notify_at", F.explode(F.sequence("_first", "ended_at", times.interval(hours=REPEAT_HOURS))))
        .select(
            *group, F.when(F.col("severity") == "critical", "critical").otherwise("default").alias("route"),
            "started_at", "notify_at", "firings",
        )
    )
