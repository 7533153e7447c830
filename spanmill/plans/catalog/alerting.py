"""Alert rules, their history and notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import alerts, drift, evals, series
from spanmill.plans import derived, jobs
from spanmill.plans.catalog.drifting import BY_DATE_SQL, daily_drift
from spanmill.plans.catalog.registry import query
from spanmill.plans.catalog.sql import END, EVALS, PRICED, PRICING, SPANS, with_

AS_OF = derived.AS_OF
HOUR = 3600
SIX_HOURS = 6 * HOUR
DAY = alerts.DAY

# The stock rules on steps that suit the thin traffic of the given tables.
HOURLY_RULES = [
    ("HighErrorRate", "critical", "error_ratio", ">", 0.15, HOUR, 2 * HOUR, "Error rate above 15%"),
    ("HighLatency", "warning", "latency_p95", ">", 2.0, HOUR, 2 * HOUR, "P95 latency above 2s"),
    ("LowEvalPassRate", "warning", "eval_pass_ratio", "<", 0.8, DAY, DAY, "Eval pass rate below 80%"),
]


def tick_sql(ts: str, step: int) -> str:
    return f"(floor(epoch_us({ts}) / {step * 1000000}.0::DOUBLE) * {step} + {step})::BIGINT"


def slide_ctes(name: str, source: str, ts: str, key: str, step: int, width: int, sums: dict[str, str]) -> list[str]:
    """Ticks, a grid of those that a window with samples ends at, and trailing sums in ``<name>_slid``."""
    return [
        f"{name}_ticks AS (SELECT {key} AS series, {tick_sql(ts, step)} AS tick, "
        + ", ".join(f"sum({e})::BIGINT AS {n}" for n, e in sums.items()) + f" FROM {source} GROUP BY 1, 2)",
        f"{name}_grid AS (SELECT DISTINCT * FROM (SELECT series, unnest(generate_series(tick, least(tick + {width}, last), {step})) AS tick "
        f"FROM (SELECT *, max(tick) OVER (PARTITION BY series) AS last FROM {name}_ticks)))",
        f"{name}_slid AS (SELECT g.series, g.tick, " + ", ".join(f"coalesce(sum(t.{n}), 0)::BIGINT AS {n}" for n in sums)
        + f" FROM {name}_grid g LEFT JOIN {name}_ticks t ON t.series = g.series AND t.tick > g.tick - {width} AND t.tick <= g.tick GROUP BY 1, 2)",
    ]


def ratio_sql(name: str, signal: str) -> str:
    return f"SELECT '{signal}' AS signal, series, tick, CASE WHEN whole > 0 THEN part::DOUBLE / whole END AS value FROM {name}_slid"


ERR = {"part": "(status_code = 'ERROR')::INT", "whole": "1"}
ERROR_CTES = slide_ctes("err", "spans", "start_time", "app_id", HOUR, SIX_HOURS, ERR)
ERROR_SIGNAL = ratio_sql("err", "error_ratio")

BOUNDS = alerts.LATENCY_BOUNDS
LATENCY_SUMS = {f"b{i}": f"(duration_ms / 1000 <= {b})::INT" for i, b in enumerate(BOUNDS)} | {"n": "1"}


def quantile_sql(name: str, signal: str, p: float = 0.95) -> str:
    branches = ["WHEN n = 0 THEN NULL"]
    low, under = "0.0::DOUBLE", "0"
    for i, b in enumerate(BOUNDS):
        branches.append(
            f"WHEN b{i} >= {p}::DOUBLE * n THEN {low} + ({b}::DOUBLE - {low}) * (({p}::DOUBLE * n - {under}) / (b{i} - {under}))")
        low, under = f"{b}::DOUBLE", f"b{i}"
    return f"SELECT '{signal}' AS signal, series, tick, CASE {' '.join(branches)} ELSE {low} END AS value FROM {name}_slid"


LATENCY_CTES = slide_ctes("lat", "spans", "start_time", "app_id", HOUR, SIX_HOURS, LATENCY_SUMS)
LATENCY_SIGNAL = quantile_sql("lat", "latency_p95")
DAILY_LATENCY_CTES = slide_ctes("dlat", "spans", "start_time", "app_id", DAY, DAY, LATENCY_SUMS)
DAILY_LATENCY_SIGNAL = quantile_sql("dlat", "latency_p95_daily")

JUDGED = (
    "judged AS (SELECT * FROM (SELECT *, CASE metric_name WHEN 'faithfulness' THEN score >= 0.7 WHEN 'toxicity' THEN score <= 0.5 "
    "WHEN 'answer_relevancy' THEN score >= 0.7 END AS ok FROM evals) WHERE ok IS NOT NULL)"
)
EVAL_CTES = [JUDGED, *slide_ctes("ev", "judged", "evaluated_at", "evaluated_model", DAY, 3 * DAY, {"part": "ok::INT", "whole": "1"})]
EVAL_SIGNAL = ratio_sql("ev", "eval_pass_ratio")

PLAN_SIGNALS = " UNION ALL ".join([
    f"SELECT 'faithfulness' AS signal, evaluated_model AS series, {tick_sql('evaluated_at', DAY)} AS tick, avg(score) AS value "
    "FROM evals WHERE metric_name = 'faithfulness' GROUP BY 1, 2, 3",
    DAILY_LATENCY_SIGNAL,
    "SELECT 'psi', 'all', " + tick_sql("score_date::TIMESTAMP", DAY) + ", avg(psi) FROM by_date_scores GROUP BY 1, 2, 3",
    f"SELECT 'daily_cost', 'all', {tick_sql('start_time', DAY)}, sum(cost_usd) FROM priced GROUP BY 1, 2, 3",
])


def rules_sql(rules: list[tuple]) -> str:
    rows = ", ".join(
        f"('{n}', '{sev}', '{sig}', '{op}', {th}::DOUBLE, {step}::BIGINT, {hold}::BIGINT, '{text}')"
        for n, sev, sig, op, th, step, hold, text in rules)
    return f"rules AS (SELECT * FROM (VALUES {rows}) AS t({alerts.RULE_COLUMNS}))"


def interval_ctes(signals: str, rules: list[tuple]) -> list[str]:
    end = f"epoch({END})::BIGINT"
    return [
        f"signals AS ({signals})",
        rules_sql(rules),
        "joined AS (SELECT r.*, s.series, s.tick, lead(s.tick) OVER (PARTITION BY alert_name, series ORDER BY tick) AS next_tick, "
        "coalesce(CASE comparator WHEN '>' THEN value > threshold ELSE value < threshold END, false) AS holds "
        "FROM signals s JOIN rules r USING (signal))",
        "islands AS (SELECT *, tick - step_seconds * row_number() OVER (PARTITION BY alert_name, series ORDER BY tick) AS island FROM joined WHERE holds)",
        "stretches AS (SELECT alert_name, severity, description, series, step_seconds, for_seconds, min(tick) AS a, max(tick) AS b, count(*) AS ticks, "
        "arg_max_null(next_tick, tick) AS nxt FROM islands "
        "GROUP BY alert_name, severity, description, series, step_seconds, for_seconds, island)",
        "intervals AS (SELECT alert_name, severity, description, series, make_timestamp(a * 1000000) AS started_at, "
        "make_timestamp(b * 1000000) AS last_breach_at, ticks, b - a >= for_seconds AS fired, "
        "CASE WHEN b - a >= for_seconds THEN make_timestamp((a + for_seconds) * 1000000) END AS fired_at, "
        f"CASE WHEN b - a >= for_seconds AND (CASE WHEN nxt = b + step_seconds THEN nxt ELSE b + 300 END) < {end} "
        "THEN make_timestamp((CASE WHEN nxt = b + step_seconds THEN nxt ELSE b + 300 END) * 1000000) END AS resolved_at FROM stretches)",
        "history AS (SELECT alert_name, severity, CASE WHEN resolved_at IS NULL THEN 'firing' ELSE 'resolved' END AS status, description, series, "
        "fired_at, resolved_at FROM intervals WHERE fired)",
    ]


INTERVALS = "SELECT * FROM intervals"
HISTORY_SQL = [SPANS, *ERROR_CTES, *LATENCY_CTES, *interval_ctes(f"{ERROR_SIGNAL} UNION ALL {LATENCY_SIGNAL}", HOURLY_RULES[:2])]


def error_signal(spark, sf):
    ratio = alerts.error_ratio(derived.spans(spark, sf), ["app_id"], HOUR, SIX_HOURS)
    return alerts.as_signal(ratio, "error_ratio", F.col("app_id"))


def latency_signal(spark, sf):
    return alerts.as_signal(alerts.latency_p95(derived.spans(spark, sf), ["app_id"], HOUR, SIX_HOURS), "latency_p95", F.col("app_id"))


def history(spark, sf):
    """Firings of the error and latency rules."""
    signals = alerts.union_signals(error_signal(spark, sf), latency_signal(spark, sf))
    return jobs.alert_job(signals, alerts.rule_table(spark, HOURLY_RULES[:2]), AS_OF)


# ---- windows on series ----

@query("sliding_ratio", with_(
    "SELECT series AS app_id, tick, make_timestamp(tick * 1000000) AS ts, part, whole, "
    "round(CASE WHEN whole > 0 THEN part::DOUBLE / whole END, 12) AS value FROM err_slid", SPANS, *ERROR_CTES), digits=12)
def sliding_ratio(spark, sf):
    return alerts.error_ratio(derived.spans(spark, sf), ["app_id"], HOUR, SIX_HOURS)


DAILY_ERRORS = slide_ctes("day", "spans", "start_time", "app_id", DAY, DAY, ERR)


@query("sustained", with_(
    "SELECT app_id, start_tick, end_tick, ticks, end_tick - start_tick >= 172800 AS fired, "
    "CASE WHEN end_tick - start_tick >= 172800 THEN start_tick + 172800 END AS fired_tick, next_tick, 86400::BIGINT AS step_seconds FROM ("
    "SELECT series AS app_id, min(tick) AS start_tick, max(tick) AS end_tick, count(*) AS ticks, arg_max_null(next_tick, tick) AS next_tick FROM ("
    "SELECT *, tick - 86400 * row_number() OVER (PARTITION BY series ORDER BY tick) AS island FROM ("
    "SELECT *, lead(tick) OVER (PARTITION BY series ORDER BY tick) AS next_tick FROM day_slid) WHERE whole > 0 AND part::DOUBLE / whole > 0.1) "
    "GROUP BY series, island)", SPANS, *DAILY_ERRORS))
def sustained(spark, sf):
    daily = alerts.error_ratio(derived.spans(spark, sf), ["app_id"], DAY, DAY)
    return series.sustained(daily, ["app_id"], DAY, 2 * DAY, F.col("value") > 0.1)


# ---- rules ----

@query("high_error_rate", with_(INTERVALS, SPANS, *ERROR_CTES, *interval_ctes(
    ERROR_SIGNAL, [("HighErrorRate", "critical", "error_ratio", ">", 0.15, HOUR, 2 * HOUR, "Error rate above 5%")])))
def high_error_rate(spark, sf):
    return alerts.high_error_rate(derived.spans(spark, sf), AS_OF, ["app_id"], HOUR, SIX_HOURS, 2 * HOUR, 0.15)


@query("high_latency", with_(INTERVALS, SPANS, *LATENCY_CTES, *interval_ctes(
    LATENCY_SIGNAL, [("HighLatency", "warning", "latency_p95", ">", 2.0, HOUR, 2 * HOUR, "P95 latency above 2s")])))
def high_latency(spark, sf):
    return alerts.high_latency(derived.spans(spark, sf), AS_OF, ["app_id"], HOUR, SIX_HOURS, 2 * HOUR)


@query("low_eval_pass_rate", with_(INTERVALS, EVALS, *EVAL_CTES, *interval_ctes(
    EVAL_SIGNAL, [("LowEvalPassRate", "warning", "eval_pass_ratio", "<", 0.8, DAY, DAY, "Eval pass rate below 80%")])))
def low_eval_pass_rate(spark, sf):
    current = derived.current_evals(spark, sf)
    return alerts.low_eval_pass_rate(current, AS_OF, ["evaluated_model"], DAY, 3 * DAY, DAY)


@query("target_down", with_(
    "SELECT target, down_from, down_from + INTERVAL 7200 SECOND AS fired_at, back AS resolved_at, round(silent, 6) AS silent_seconds, 'critical' AS severity "
    "FROM (SELECT *, (epoch_us(coalesce(back, " + END + ")) - epoch_us(down_from)) / 1000000.0::DOUBLE AS silent FROM ("
    "SELECT app_id AS target, start_time AS down_from, lead(start_time) OVER (PARTITION BY app_id ORDER BY start_time) AS back FROM spans)) WHERE silent > 7200",
    SPANS))
def target_down(spark, sf):
    beats = derived.spans(spark, sf).select(F.col("app_id").alias("target"), F.col("start_time").alias("ts"))
    return alerts.target_down(beats, AS_OF, silence_seconds=7200)


PLAN_CTES = [SPANS, PRICING, PRICED, EVALS, BY_DATE_SQL, *DAILY_LATENCY_CTES]


def plan_signals(spark, sf):
    spans = derived.priced_spans(spark, sf)
    current = derived.current_evals(spark, sf).filter("metric_name = 'faithfulness'")
    by_day = alerts.daily_average(current, "evaluated_at", F.col("score"), ["evaluated_model"])
    slow = alerts.latency_p95(spans, ["app_id"], DAY, DAY)
    drifted = daily_drift(spark, sf).withColumn("ts", F.col("score_date").cast("timestamp"))
    return alerts.union_signals(
        alerts.as_signal(by_day, "faithfulness", F.col("evaluated_model")),
        alerts.as_signal(slow, "latency_p95_daily", F.col("app_id")),
        alerts.as_signal(alerts.daily_average(drifted, "ts", F.col("psi"), []), "psi"),
        alerts.as_signal(alerts.daily_sum(spans, "start_time", F.col("cost_usd"), []), "daily_cost"),
    )


@query("plan_rules", with_(INTERVALS, *PLAN_CTES, *interval_ctes(PLAN_SIGNALS, alerts.PLAN_RULES)))
def plan_rules(spark, sf):
    return alerts.evaluate_rules(plan_signals(spark, sf), alerts.rule_table(spark, alerts.PLAN_RULES), AS_OF)


@query("drift_alert", with_(
    "SELECT score_date, round(avg(psi), 6) AS psi, CASE WHEN avg(psi) > 0.25 THEN 'critical' ELSE 'warning' END AS severity "
    "FROM by_date_scores GROUP BY score_date HAVING avg(psi) > 0.2", BY_DATE_SQL))
def drift_alert(spark, sf):
    daily = drift.psi(daily_drift(spark, sf), ["score_date"]).select("score_date", "psi")
    return alerts.drift_alerts(daily)


ALL_RULES = HOURLY_RULES + alerts.PLAN_RULES
ALL_CTES = [*PLAN_CTES, *ERROR_CTES, *LATENCY_CTES, *EVAL_CTES]
ALL_SIGNALS = " UNION ALL ".join([ERROR_SIGNAL, LATENCY_SIGNAL, EVAL_SIGNAL, PLAN_SIGNALS])


def all_signals(spark, sf):
    current = derived.current_evals(spark, sf)
    passing = alerts.as_signal(
        alerts.eval_pass_ratio(current, ["evaluated_model"], DAY, 3 * DAY), "eval_pass_ratio", F.col("evaluated_model"))
    return alerts.union_signals(error_signal(spark, sf), latency_signal(spark, sf), passing, plan_signals(spark, sf))


@query("evaluate_rules", with_(INTERVALS, *ALL_CTES, *interval_ctes(ALL_SIGNALS, ALL_RULES)))
def evaluate_rules(spark, sf):
    return alerts.evaluate_rules(all_signals(spark, sf), alerts.rule_table(spark, ALL_RULES), AS_OF)


@query("alert_history", with_("SELECT * FROM history", *HISTORY_SQL))
def alert_history(spark, sf):
    return history(spark, sf)


NOTICES = [
    "ends AS (SELECT *, coalesce(resolved_at, " + END + ") AS until FROM history)",
    "marked_new AS (SELECT *, CASE WHEN fired_at <= max(until) OVER (PARTITION BY alert_name, severity ORDER BY fired_at "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS is_new FROM ends)",
    "numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY alert_name, severity ORDER BY fired_at ROWS UNBOUNDED PRECEDING) AS episode FROM marked_new)",
    "episodes AS (SELECT alert_name, severity, min(fired_at) AS started_at, max(until) AS ended_at, count(*) AS firings FROM numbered "
    "GROUP BY alert_name, severity, episode)",
]


@query("group_notifications", with_(
    "SELECT alert_name, severity, CASE WHEN severity = 'critical' THEN 'critical' ELSE 'default' END AS route, started_at, "
    "unnest(generate_series(started_at + to_seconds(CASE WHEN severity = 'critical' THEN 10 ELSE 30 END), ended_at, INTERVAL 4 HOUR)) AS notify_at, firings "
    "FROM episodes", *HISTORY_SQL, *NOTICES))
def group_notifications(spark, sf):
    return alerts.group_notifications(history(spark, sf), AS_OF)
