import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanmill.operators import (
    histograms, alerts, cost, drift, evals, incidents, metrics, quality, rollups, scoring, series, trees,
)
from spanmill.operators.latest import latest_per_key
from spanmill.operators.normalize import with_defaults
from spanmill.operators.quantiles import exact_quantiles
from spanmill.operators.skew import join_per_key
from spanmill.operators.tail_sampling import tail_sample
from spanmill.schemas import SPANS
from spanmill.sources.pricing import seed_pricing

AS_OF = "2024-02-01 00:00:00"


def spans_from(spark, rows):
    """(trace, span, parent, model, status, start, duration) tuples as full span rows."""
    df = spark.createDataFrame(
        rows, "trace_id string, span_id string, parent_span_id string, model string, status_code string, start_time string, duration_ms double")
    df = df.withColumn("start_time", F.col("start_time").cast("timestamp")).withColumn("provider", F.lit("openai"))
    return with_defaults(df.withColumns({"input_tokens": F.lit(1000), "output_tokens": F.lit(500)}), AS_OF)


def span(trace, sid, parent="", status="OK", duration=1.0, start="2024-01-31 23:00:00", model="gpt-4o"):
    return (trace, sid, parent, model, status, start, duration)


# ---- quantiles ----

@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_equal_numpy(spark, seed):
    rng = random.Random(seed)
    data = {
        "normal": [rng.gauss(0, 5) for _ in range(801)],
        "ties": [float(rng.randint(-2, 2)) for _ in range(500)],
        "one": [7.0], "two": [1.0, 2.0], "flat": [3.0] * 50,
        "wide": [10 ** rng.uniform(-9, 9) for _ in range(300)],
    }
    rows = [(k, v) for k, values in data.items() for v in values] + [("normal", None), ("nulls", None)]
    probs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, "v", probs, ["k"]).collect()}
    assert set(got) == set(data)
    for k, values in data.items():
        assert got[k].n == len(values)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
    whole = exact_quantiles(df, "v", {"p95": 0.95}).first()
    assert whole.p95 == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.95))


def test_exact_quantiles_of_nothing(spark):
    nothing = spark.range(0).select(F.col("id").alias("k"), F.col("id").cast("double").alias("v"))
    assert exact_quantiles(nothing, "v", {"p": 0.5}).first().p is None
    assert exact_quantiles(nothing, "v", {"p": 0.5}, ["k"]).count() == 0


# ---- skew ----

def test_hot_key_is_spread_and_joined_once(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.col("id").cast("string").alias("row_id"))
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("key_rows"), F.max(F.col("row_id").cast("int")).alias("top"))
    joined = join_per_key(rows, per_key, ["k"], "row_id", hot_floor=100)
    plain = rows.join(per_key.drop("key_rows"), "k")
    assert joined.columns == ["k", "row_id", "top"]
    assert joined.exceptAll(plain).count() == 0 and joined.count() == 3000
    semi = join_per_key(rows, per_key, ["k"], "row_id", how="left_semi", match=F.col("top") < 2000, hot_floor=100)
    assert semi.count() == 2000


# ---- trees ----

def brute_depth(edges):
    parent = {s: p for s, p in edges}
    out = {}
    for s in parent:
        seen, cur, depth = set(), s, 0
        while parent[cur] in parent:
            if cur in seen:
                depth = None
                break
            seen.add(cur)
            cur, depth = parent[cur], depth + 1
        out[s] = depth
    return out


def test_depth_of_chains_cycles_and_orphans(spark):
    rng = random.Random(5)
    edges = [("c0", "")] + [(f"c{i}", f"c{i - 1}") for i in range(1, 40)]
    edges += [("x", "y"), ("y", "x"), ("under", "x"), ("deeper", "under"), ("self", "self"), ("orphan", "nowhere"), ("child", "orphan")]
    edges += [(f"t{i}", f"t{rng.randrange(i)}" if i else "") for i in range(60)]
    df = spans_from(spark, [span("T", s, p) for s, p in edges] + [span("U", "c5", "c4")])
    got = {(r.trace_id, r.span_id): r.depth for r in trees.span_depth(df).collect()}
    want = {("T", s): d for s, d in brute_depth(edges).items()}
    want[("U", "c5")] = 0
    assert got == want
    cyclic = {r.span_id for r in quality.cyclic_spans(trees.span_depth(df)).collect()}
    assert cyclic == {"x", "y", "under", "deeper", "self"}


def test_children_of_one_parent_are_spread(spark, monkeypatch):
    monkeypatch.setattr(trees, "join_per_key", lambda *a, **k: join_per_key(*a, **k, hot_floor=10))
    edges = [("root", ""), ("hub", "root")] + [(f"k{i}", "hub") for i in range(300)] + [("last", "k7")]
    df = spans_from(spark, [span("T", s, p) for s, p in edges])
    got = {r.span_id: r.depth for r in trees.span_depth(df).collect()}
    assert got == brute_depth(edges)


def test_spans_without_trace_id_are_roots(spark):
    df = spans_from(spark, [span("T", "a"), span("T", "b", "a")]).withColumn("trace_id", F.when(F.col("span_id") == "a", F.col("trace_id")))
    assert sorted((r.span_id, r.depth) for r in trees.span_depth(df).collect()) == [("a", 0), ("b", 0)]


def test_repeated_span_counts_once(spark):
    df = spans_from(spark, [span("T", "a"), span("T", "b", "a"), span("T", "b", "a")])
    assert sorted((r.span_id, r.depth) for r in trees.span_depth(df).collect()) == [("a", 0), ("b", 1)]


def test_waterfall_widths(spark):
    df = spans_from(spark, [span("T", "a", duration=200.0), span("T", "b", "a", duration=50.0), span("T", "c", "a", duration=1.0), span("S", "z", duration=0.2)])
    rows = [(r.trace_id, r.span_id, r.depth, r.width_pct) for r in trees.waterfall(df).collect()]
    assert rows == [("S", "z", 0, 20.0), ("T", "a", 0, 100.0), ("T", "b", 1, 25.0), ("T", "c", 1, 2.0)]
    assert trees.waterfall(df, "S").count() == 1
    assert trees.waterfall(df, "none").count() == 0


# ---- cost ----

def test_price_fallback_and_unpriced(spark):
    df = spans_from(spark, [span("T", "a"), span("T", "b", model="mystery"), span("T", "c", model="claude-3-5-sonnet-20241022")])
    df = df.withColumn("provider", F.when(F.col("span_id") == "c", "langchain").otherwise("openai"))
    got = {r.span_id: r.cost_usd for r in cost.price_spans(df, seed_pricing(spark)).collect()}
    assert got["a"] == pytest.approx(0.0025 + 0.005) and got["b"] is None
    assert got["c"] == pytest.approx(0.003 + 0.0075)
    report = {r.model: (r.cost, r.unpriced_spans) for r in cost.cost_by_model(cost.price_spans(df, seed_pricing(spark)), AS_OF).collect()}
    assert report["mystery"] == (None, 1)


def test_newest_price_wins(spark):
    newer = seed_pricing(spark).filter("model_name = 'gpt-4o'").withColumns(
        {"input_cost_per_1k": F.lit(1.0), "output_cost_per_1k": F.lit(0.0), "updated_at": F.lit("2024-06-01").cast("timestamp")})
    priced = cost.price_spans(spans_from(spark, [span("T", "a")]), seed_pricing(spark).unionByName(newer))
    assert priced.first().cost_usd == pytest.approx(1.0)


def test_empty_windows(spark):
    none = spans_from(spark, [span("T", "a", start="2020-01-01 00:00:00")])
    assert cost.total_cost(none.withColumn("cost_usd", F.lit(1.0)), AS_OF).first().total_cost == 0.0
    assert metrics.span_count(none, AS_OF).first().span_count == 0
    values = {r.label: r.value for r in metrics.kpis(none, AS_OF).collect()}
    assert values == {"Spans/sec": "0.0", "Cost": "$0.0000", "P95 Latency": "0", "Traces": "0"}
    assert [r.change_pct for r in metrics.kpi_change(none, AS_OF).collect()] == [None] * 4


# ---- latest, evals ----

def test_latest_per_key_is_idempotent(spark):
    df = spark.createDataFrame([("a", "m", 1, "x"), ("a", "m", 2, "y"), ("a", "m", 2, "z"), ("b", "m", 1, None)], "k string, m string, v int, t string")
    once = latest_per_key(df, ["k", "m"], "v", "t")
    assert sorted(tuple(r) for r in once.collect()) == [("a", "m", 2, "z"), ("b", "m", 1, None)]
    assert once.exceptAll(latest_per_key(once, ["k", "m"], "v", "t")).count() == 0


def test_pass_rules_and_missing_metrics(spark):
    df = spark.createDataFrame(
        [("m1", "faithfulness", 0.7), ("m1", "toxicity", 0.5), ("m1", "toxicity", 0.6), ("m2", "other", 0.1)], "evaluated_model string, metric_name string, score double"
    ).withColumn("evaluated_at", F.lit("2024-01-31").cast("timestamp"))
    rates = {r.metric_name: (r.eval_count, r.pass_rate) for r in evals.eval_pass_rate(df).collect()}
    assert rates == {"faithfulness": (1, 1.0), "toxicity": (2, 0.5)}
    rows = evals.model_comparison(df, AS_OF).collect()
    assert [r.model for r in rows] == ["m1", "m2"] and rows[1].faithfulness is None and rows[1].eval_count == 1


# ---- rollups ----

def test_hours_from_minutes_equal_hours_from_spans(spark):
    rng = random.Random(3)
    df = spans_from(spark, [span("T", str(i), duration=rng.uniform(1, 900), start=f"2024-01-31 {i % 3:02}:{i % 60:02}:00") for i in range(700)])
    exact = ["hour", "model", "span_count", "total_tokens", "error_count"]
    minutes = rollups.rollup_minute(df)
    hours = rollups.rollup_hour(minutes)
    direct = rollups.span_rollup(df, "hour", F.date_trunc("hour", "start_time"))
    assert hours.select(exact).exceptAll(direct.select(exact)).count() == 0
    for r in hours.collect():
        values = sorted(x.duration_ms for x in df.filter(F.date_trunc("hour", "start_time") == r.hour).collect())
        assert r.p95_latency_ms == values[math.ceil(0.95 * len(values)) - 1]


def test_merged_evals_keep_their_average(spark):
    df = spark.createDataFrame([("m", "f", 0.2), ("m", "f", 0.4), ("m", "f", 0.9)], "evaluated_model string, metric_name string, score double").withColumn(
        "evaluated_at", F.lit("2024-01-31 10:00:00").cast("timestamp"))
    parts = [rollups.eval_daily(df.filter("score < 0.5")), rollups.eval_daily(df.filter("score > 0.5"))]
    row = rollups.merge_eval_daily(*parts).first()
    assert (row.eval_count, row.min_score, row.max_score) == (3, 0.2, 0.9) and row.avg_score == pytest.approx(0.5)


# ---- series and alerts ----

def ticks(spark, values, step=15, series_name="s"):
    return spark.createDataFrame([(series_name, i * step, v) for i, v in values], "series string, tick bigint, value double")


def test_sustained_needs_its_time_and_breaks_on_gaps(spark):
    df = ticks(spark, [(0, 1.0), (1, 1.0), (2, 1.0), (3, 0.0), (4, 1.0), (6, 1.0), (7, None)])
    rows = series.sustained(df, ["series"], 15, 30, F.col("value") > 0.5).orderBy("start_tick").collect()
    assert [(r.start_tick, r.end_tick, r.ticks, r.fired, r.fired_tick, r.next_tick) for r in rows] == [
        (0, 30, 3, True, 30, 45), (60, 60, 1, False, None, 90), (90, 90, 1, False, None, 105)]


def test_rules_resolve_stay_open_or_fall_silent(spark):
    rules = alerts.rule_table(spark, [("A", "critical", "x", ">", 0.5, 15, 15, "text")])
    signal = lambda name, values: ticks(spark, values, series_name=name)
    df = signal("resolved", [(0, 1.0), (1, 1.0), (2, 0.0)]).unionByName(signal("silent", [(0, 1.0), (1, 1.0)])).unionByName(
        signal("open", [(98, 1.0), (99, 1.0)])).withColumn("signal", F.lit("x"))
    found = alerts.evaluate_rules(df, rules, "1970-01-01 00:25:00")
    got = {r.series: (r.fired_at.minute, r.resolved_at and (r.resolved_at.minute, r.resolved_at.second)) for r in alerts.alert_history(found).collect()}
    assert got == {"resolved": (0, (0, 30)), "silent": (0, (5, 15)), "open": (24, None)}
    active = alerts.active_alerts(alerts.alert_history(found)).collect()
    assert [(r.name, r.status) for r in active] == [("A", "firing")]


def test_empty_denominator_breaches_nothing(spark):
    df = spans_from(spark, [span("T", "a", "", "ERROR", start="2024-01-31 10:00:00"), span("T", "b", start="2024-01-31 12:00:00")])
    ratio = alerts.error_ratio(df, [], 15, 300).orderBy("tick").collect()
    assert len(ratio) == 481
    assert ratio[0].value == 1.0 and ratio[100].value is None and ratio[-1].value == 0.0


def test_histogram_quantile(spark):
    df = spark.createDataFrame(
        [("a", "0.5", 50), ("a", "2.0", 90), ("a", "5.0", 100), ("a", "+Inf", 100), ("b", "0.5", 0), ("b", "2.0", 0), ("b", "5.0", 0), ("b", "+Inf", 9),
         ("c", "0.5", 0), ("c", "2.0", 0), ("c", "5.0", 0), ("c", "+Inf", 0)], "k string, le string, bucket_count bigint")
    got = {r.k: r.q for r in metrics.histogram_quantile(df, ["k"], 0.95, "q").collect()}
    assert got["a"] == pytest.approx(3.5) and got["b"] == 5.0 and got["c"] is None


def test_target_down(spark):
    df = spark.createDataFrame([("t", "2024-01-31 10:00:00"), ("t", "2024-01-31 10:01:00"), ("t", "2024-01-31 10:10:00")], "target string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = alerts.target_down(df, "2024-01-31 10:30:00").orderBy("down_from").collect()
    assert [(r.silent_seconds, r.resolved_at is None) for r in rows] == [(540.0, False), (1200.0, True)]


def test_notifications_group_and_repeat(spark):
    rows = [("A", "critical", "2024-01-31 00:00:00", "2024-01-31 09:00:00"), ("A", "critical", "2024-01-31 01:00:00", "2024-01-31 02:00:00"),
            ("A", "critical", "2024-01-31 20:00:00", None), ("B", "warning", "2024-01-31 00:00:00", "2024-01-31 00:00:20")]
    df = spark.createDataFrame(rows, "alert_name string, severity string, fired_at string, resolved_at string")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("fired_at", "resolved_at")})
    got = alerts.group_notifications(df, "2024-01-31 22:00:00").orderBy("notify_at").collect()
    assert [(r.route, r.notify_at.hour, r.notify_at.second, r.firings) for r in got] == [
        ("critical", 0, 10, 2), ("critical", 4, 10, 2), ("critical", 8, 10, 2), ("critical", 20, 10, 1)]


def test_episodes_equal_a_sweep_over_all_firings(spark):
    rng = random.Random(3)
    day = 1_706_659_200
    rows = []
    for _ in range(900):
        start = day + rng.randrange(0, 40_000, 15)
        length = rng.choice((0, 15, 120, 3_000)) if rng.random() < 0.98 else 9_000
        rows.append((rng.choice(("A", "A", "A", "B", None)), "warning", start, start + length if rng.random() < 0.95 else None))
    rows.append(("A", "warning", None, day))
    df = spark.createDataFrame(rows, "alert_name string, severity string, f bigint, r bigint")
    df = df.select("alert_name", "severity", F.timestamp_seconds("f").alias("fired_at"), F.timestamp_seconds("r").alias("resolved_at"))
    end = day + 21_600
    got = alerts.episodes(df, "2024-01-31 06:00:00", ["alert_name"]).selectExpr("alert_name", "unix_seconds(started_at)", "unix_seconds(ended_at)", "firings")
    want = []
    for name in ("A", "B", None):
        opened = None
        for _, _, start, stop in sorted((r for r in rows if r[0] == name and r[2] is not None), key=lambda r: r[2]):
            stop = end if stop is None else stop
            if opened is None or start > opened[2]:
                opened = [name, start, stop, 0]
                want.append(opened)
            opened[2] = max(opened[2], stop)
            opened[3] += 1
    assert sorted(map(str, (list(r) for r in got.collect()))) == sorted(map(str, want))


def test_episodes_of_one_alert_are_spread_over_slots(spark):
    firing = spark.range(200_000).select(
        F.lit("A").alias("alert_name"), F.lit("warning").alias("severity"),
        F.timestamp_seconds(F.lit(1_706_659_200) + F.col("id") % 20_000).alias("fired_at"),
        F.timestamp_seconds(F.lit(1_706_659_200) + F.col("id") % 20_000 + 5).alias("resolved_at"))
    found = alerts.episodes(firing, "2024-02-01 00:00:00", ["alert_name"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    over_starts = [line for line in windows if "[fired_at#" in line]
    assert over_starts and all(re.search(r"_slot#\d+L\], \[fired_at#", line) for line in over_starts)
    assert [(r.firings, (r.ended_at - r.started_at).total_seconds()) for r in found.collect()] == [(200_000, 20_004.0)]


# ---- incidents ----

def test_first_hit_equals_brute_force(spark):
    rng = random.Random(11)
    day = 1_704_067_200
    starts = [(f"i{n}", rng.choice("ab"), day + rng.randrange(90_000)) for n in range(120)]
    hits = [(rng.choice("ab"), day + rng.randrange(80_000)) for _ in range(60)] + [("a", starts[0][2])]
    s = spark.createDataFrame(starts, "incident_id string, scope string, t bigint").withColumn("injected_at", F.timestamp_seconds("t"))
    h = spark.createDataFrame(hits, "scope string, t bigint").withColumn("detected_at", F.timestamp_seconds("t"))
    got = {r.incident_id: r.detect_seconds for r in incidents.detection_latency(s, h).collect()}
    for iid, scope, t in starts:
        later = [x - t for k, x in hits if k == scope and x >= t]
        assert got[iid] == (min(later) if later else None)


def test_report_needs_a_detection(spark):
    at = F.lit("2024-01-31 10:00:00").cast("timestamp")
    inc = spark.createDataFrame([("i", "a"), ("j", "b")], "incident_id string, scope string").withColumn("injected_at", at)
    hit = spark.createDataFrame([("a",)], "scope string").withColumn("detected_at", at + F.expr("INTERVAL 60 SECOND"))
    fired = hit.select("scope", F.col("detected_at").alias("fired_at"))
    got = {r.incident_id: (r.detect_seconds, r.passed) for r in incidents.regression_report(inc, hit, fired).collect()}
    assert got == {"i": (60.0, True), "j": (None, False)}


# ---- drift ----

def numpy_scores(base, cur, bins=10):
    out = []
    for d in range(base.shape[1]):
        b, c = base[:, d].astype(float), cur[:, d].astype(float)
        lo, hi = min(b.min(), c.min()), max(b.max(), c.max())
        if lo == hi:
            out.append((0.0, 0.0))
            continue
        edges = np.linspace(lo, hi, bins + 1)
        hb = np.maximum(np.histogram(b, edges, density=True)[0], 1e-6)
        hc = np.maximum(np.histogram(c, edges, density=True)[0], 1e-6)
        hb, hc = hb / hb.sum(), hc / hc.sum()
        out.append((float(((hc - hb) * np.log(hc / hb)).sum()), max(float((hb * np.log(hb / hc)).sum()), 0.0)))
    return out


def vectors(spark, base, cur):
    rows = [("baseline", [float(x) for x in v]) for v in base] + [("current", [float(x) for x in v]) for v in cur]
    return spark.createDataFrame(rows, "side string, embedding array<float>")


def test_drift_scores_equal_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (120, 6)).astype(np.float32)
    cur = rng.normal(0.4, 1.2, (90, 6)).astype(np.float32)
    base[:, 3] = cur[:, 3] = 0.5
    got = drift.drift_by_dimension(vectors(spark, base, cur)).orderBy("dim").collect()
    for row, (p, k) in zip(got, numpy_scores(base, cur)):
        assert row.psi == pytest.approx(p, abs=1e-9) and row.kl_divergence == pytest.approx(k, abs=1e-9)
        assert (row.n_baseline, row.n_current) == (120, 90)
    swapped = drift.drift_by_dimension(vectors(spark, cur, base)).orderBy("dim").collect()
    assert [r.psi for r in swapped] == pytest.approx([r.psi for r in got])


def test_equal_sides_have_no_drift_and_the_gate_holds(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(0, 1, (12, 3)).astype(np.float32)
    scores = drift.drift_by_dimension(vectors(spark, base, base))
    assert all(r.psi == pytest.approx(0) and r.kl_divergence == pytest.approx(0) for r in scores.collect())
    assert drift.score_rows(scores, AS_OF).count() == 6
    few = drift.score_rows(drift.drift_by_dimension(vectors(spark, base, base[:9])), AS_OF)
    assert few.count() == 6 and few.filter("enough").count() == 0


def grouped(spark, apps=5, dims=130, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for app in range(apps):
        for k in range(60 if app else 400):
            side = ("baseline", "current")[int(rng.integers(2))]
            rows.append((f"app {app}", side, (rng.normal(app, 1 + app, dims) + (side == "current") * 0.5).tolist()))
    return rows


APPS = "app_id string, side string, embedding array<double>"


@pytest.mark.parametrize("state", [histograms.STATE_BYTES, 1000])
def test_drift_by_app_equals_numpy(spark, monkeypatch, state):
    """Both ways: all groups in a task, and vectors dealt by group with a hot one split."""
    monkeypatch.setattr(histograms, "STATE_BYTES", state)
    monkeypatch.setattr(histograms, "SPLIT_ROWS", 100)
    rows = grouped(spark)
    got = {r["app_id"]: r for r in drift.drift_by_app(spark.createDataFrame(rows, APPS).repartition(5)).collect()}
    for app in {r[0] for r in rows}:
        base, cur = (np.array([v for a, s, v in rows if a == app and s == side]) for side in ("baseline", "current"))
        scores = numpy_scores(base, cur)
        assert got[app]["psi"] == pytest.approx(np.mean([p for p, _ in scores]), abs=1e-9)
        assert got[app]["max_psi"] == pytest.approx(max(p for p, _ in scores), abs=1e-9)
        assert got[app]["kl_divergence"] == pytest.approx(np.mean([k for _, k in scores]), abs=1e-9)
        assert (got[app]["n_baseline"], got[app]["n_current"]) == (len(base), len(cur))


@pytest.mark.parametrize("state", [histograms.STATE_BYTES, 1000])
def test_counts_of_odd_vectors(spark, monkeypatch, state):
    """Nulls, NaN, other lengths, sides and groups without a name."""
    monkeypatch.setattr(histograms, "STATE_BYTES", state)
    rows = [("a", "baseline", [0.0, 1.0]), ("a", "current", [10.0, None, 5.0]), ("a", "current", [float("nan"), 3.0]), ("a", "other", [99.0, 99.0]), ("a", "baseline", None), ("a", "baseline", []), (None, "current", [7.0])]
    got = histograms.dim_counts(spark.createDataFrame(rows, APPS), "embedding", "side", ["app_id"], 10).collect()
    counted = {(r["app_id"], r["dim"]): (r["range_width"], r["baseline"].index(1) if 1 in r["baseline"] else None, r["current"].index(1) if 1 in r["current"] else None) for r in got}
    assert counted == {("a", 0): (10.0, 0, 9), ("a", 1): (2.0, 0, 9), ("a", 2): (0.0, None, 0), (None, 0): (0.0, None, 0)}
    assert histograms.dim_counts(spark.createDataFrame([], APPS), "embedding", "side", [], 10).count() == 0


def test_wide_vectors_of_many_apps_make_no_row_for_each_entry(spark):
    wide = spark.range(1500).select(
        (F.col("id") % 300).cast("string").alias("app_id"), F.when(F.col("id") % 2 == 0, "baseline").otherwise("current").alias("side"),
        F.transform(F.sequence(F.lit(1), F.lit(1536)), lambda i: F.sin(i * (F.col("id") + 1))).alias("embedding"))
    counts = histograms.dim_counts(wide, "embedding", "side", ["app_id"], 10)
    assert counts.count() == 300 * 1536
    # Unfolded are salts and the places in a folded piece, never a vector.
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(embedding" not in plan and "explode(vector" not in plan and "MapInArrow" in plan


def test_embedding_is_unit_length(spark):
    df = spark.createDataFrame([("a b a",), ("",)], "t string")
    got = [r.embedding for r in drift.embed_text(df, "t", dims=16).collect()]
    assert np.linalg.norm(got[0]) == pytest.approx(1.0, abs=1e-6) and len(got[0]) == 16
    assert not any(got[1])


# ---- scoring ----

def responses(spark, rows):
    df = spark.createDataFrame(rows, "span_id string, question string, response string, context string, passages array<string>")
    return df.withColumns({c: F.lit("x") for c in ("trace_id", "parent_span_id", "provider", "model")})


def test_lexical_scores(spark):
    df = responses(spark, [("s", "what is spark", "Spark is fast. Bees sing", "spark is very fast", ["nothing here", "spark is", "fast spark is bees"]), ("e", "", "", "", [])])
    got = {r.span_id: r for r in df.select("span_id", scoring.faithfulness().alias("f"), scoring.answer_relevancy().alias("a"),
                                           scoring.context_precision().alias("p"), scoring.context_recall().alias("r"), scoring.toxicity().alias("t")).collect()}
    s = got["s"]
    assert s.f == pytest.approx(3 / 5) and s.a == pytest.approx(2 / math.sqrt(15))
    assert s.p == pytest.approx((1 / 2 + 2 / 3) / 2) and s.r == pytest.approx(1 / 2) and s.t == 0.0
    assert tuple(got["e"])[1:] == (None, None, None, None, None)


def test_large_lexicon_gives_the_same_shares(spark):
    df = responses(spark, [("a", "", "Bad good bad", "", []), ("b", "", "good", "", []), ("c", "", "", "", [])])
    lexicon = spark.createDataFrame([("BAD",), ("awful",), ("bad",)], "word string")
    for limit in (10, 0):
        shares = {r.span_id: r.toxicity for r in scoring.toxicity_by_lexicon(df, "span_id", lexicon, broadcast_rows=limit, salts=3).collect()}
        assert shares == {"a": pytest.approx(2 / 3), "b": 0.0, "c": None}


def test_a_failing_metric_leaves_the_others(spark):
    def make():
        return lambda text: 1 / len(text)

    df = responses(spark, [("good", "q", "abcd", "c", []), ("bad", "q", "", "c", [])])
    scores = scoring.score_responses(df, {"py": scoring.python_scorer(make, "response"), "one": F.lit(1.0)}, AS_OF)
    assert sorted((r.span_id, r.metric_name, r.score) for r in scoring.kept_scores(scores).collect()) == [("bad", "one", 1.0), ("good", "one", 1.0), ("good", "py", 0.25)]
    failed = scoring.failed_scores(scores).collect()
    assert [(r.span_id, r.metric_name) for r in failed] == [("bad", "py")] and "ZeroDivisionError" in failed[0].error


# ---- sampling, quality ----

def test_tail_sample_keeps_whole_failing_traces(spark):
    df = spans_from(spark, [span("T", "a"), span("T", "b", "a", "ERROR"), span("S", "c"), span("R", "d", duration=6000.0)])
    assert {r.span_id for r in tail_sample(df, rate=0.0).collect()} == {"a", "b"}
    assert {r.span_id for r in tail_sample(df, rate=0.0, slow_ms=5000.0).collect()} == {"a", "b", "d"}
    assert tail_sample(df, rate=1.0).count() == 4


def test_quality_findings(spark):
    df = spans_from(spark, [span("T", "a"), span("T", "b", "gone"), span("0" * 32, "c")])
    row = quality.span_quality(df).first()
    assert (row.span_count, row.bad_trace_ids, row.no_input_tokens) == (3, 2, 0)
    assert [r.span_id for r in quality.orphan_spans(df).collect()] == ["b"]
    assert {r.provider for r in quality.missing_providers(df).collect()} == set(quality.EXPECTED_PROVIDERS) - {"openai"}
    assert {r.scope: r.enough for r in quality.min_span_count(df).collect()}["total"] is False


def test_defaults_give_the_full_row(spark):
    row = with_defaults(spark.createDataFrame([("t",)], "trace_id string"), AS_OF).first()
    assert row.__fields__ == SPANS.names and row.attributes == "{}" and row.cost_usd == 0.0 and row.user_id == ""


def test_prices_of_dated_and_plain_names(spark):
    from spanmill.operators.cost import cost_by_model, price_book, price_spans

    pricing = spark.sql(
        "SELECT * FROM VALUES ('gpt-4o', 'openai', 2.0D, 0.0D, TIMESTAMP '2024-01-01'), ('gpt-4o', 'openai', 3.0D, 0.0D, TIMESTAMP '2024-06-01'),"
        " ('gpt-4o-2024-05-13', 'openai', 5.0D, 0.0D, TIMESTAMP '2024-09-01'), ('tied', 'a', 9.0D, 0.0D, TIMESTAMP '2024-01-01'),"
        " ('tied', 'a', 8.0D, 0.0D, TIMESTAMP '2024-01-01'), ('undated', 'a', 7.0D, 0.0D, null)"
        " AS t(model_name, provider, input_cost_per_1k, output_cost_per_1k, updated_at)"
    )
    asked = [("gpt-4o", "openai", 3.0), ("gpt-4o-2024-05-13", "openai", 5.0), ("gpt-4o-2024-08-06", "openai", 3.0), ("gpt-4o-2024-05-13", "wrapper", 5.0),
             ("tied", "a", 8.0), ("undated", "b", 7.0), ("nowhere", "a", None)]
    spans = spark.createDataFrame([(m, p, 1000, 0) for m, p, _ in asked], "model string, provider string, input_tokens int, output_tokens int")
    priced = price_spans(spans.withColumn("start_time", F.to_timestamp(F.lit("2024-10-01 00:00:00"))), pricing)
    assert {(r.model, r.provider): r.cost_usd for r in priced.collect()} == {(m, p): c for m, p, c in asked}
    assert {r.model: r.unpriced_spans for r in cost_by_model(priced, "2024-10-01 12:00:00").collect()}["nowhere"] == 1
    assert {r.price_key: r.colliding for r in price_book(pricing).collect()}["tied"] == 1


def test_selections_and_pages_have_no_cap(spark):
    from spanmill.operators import alerts, drift, pii, search

    spans = spark.range(6000).select(
        F.format_string("%016x", "id").alias("span_id"), F.lit("CLIENT").alias("span_kind"), F.lit("langchain-x").alias("service_name"),
        F.lit("ask").alias("span_name"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("start_time"),
    )
    as_of = "2024-01-01 00:05:00"
    assert search.recent_client_spans(spans, as_of).count() == search.rag_spans(spans, as_of).count() == search.recent_prompts(spans, as_of).count() == 6000
    assert search.recent_client_spans(spans, as_of, limit=100).count() == 100
    fired = spark.range(250).select(
        F.lit("a").alias("alert_name"), F.lit("warning").alias("severity"), F.lit("firing").alias("status"), F.lit("").alias("description"),
        F.col("id").cast("string").alias("series"), F.timestamp_seconds("id").alias("fired_at"), F.lit(None).cast("timestamp").alias("resolved_at"),
    )
    assert alerts.alert_timeline(fired).count() == 250
    assert [r.series for r in alerts.alert_timeline(fired, limit=2, offset=100).collect()] == ["149", "148"]
    late = spark.createDataFrame([("t", "x" * 900 + " 219-09-9999 a@b.org")], "trace_id string, response string")
    assert "219-09-9999" in pii.triage(late, as_of).first().response_text
    assert len(pii.triage(late, as_of, max_chars=500).first().response_text) == 500
    few = spark.createDataFrame([(0, 0.4, 0.1, 50, 3), (1, 0.4, 0.1, 50, 30)], "dim int, psi double, kl_divergence double, n_baseline long, n_current long")
    rows = drift.score_rows(few, "2024-01-31 00:00:00")
    assert {(r.dimension_index, r.enough, r.n_current) for r in rows.collect()} == {(0, False, 3), (1, True, 30)}
    assert drift.psi_trend(rows, "2024-02-01 00:00:00").first().avg_score == 0.4


def test_unknown_span_kind_counts_as_unspecified(spark):
    from spanmill.sources import otlp

    kinds = spark.createDataFrame([("9",), ("2",), ("SPAN_KIND_CLIENT",), (None,)], "k string")
    found = [r[0] for r in kinds.select(otlp._enum(F.col("k"), ["UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT"], "SPAN_KIND_")).collect()]
    assert found == ["UNSPECIFIED", "SERVER", "CLIENT", "UNSPECIFIED"]


def test_quantiles_of_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, inf, -inf, float("nan"), None, 3.0)], "v double")
    row = exact_quantiles(df, "v", {"low": 0.0, "mid": 0.5, "high": 1.0}).first()
    assert (row.n, row.low, row.mid, row.high) == (5, -inf, 2.0, inf)


def test_an_early_sample_does_not_stretch_the_grid(spark):
    spans = spark.sql("SELECT * FROM VALUES (TIMESTAMP '1970-01-01 00:00:10'), (TIMESTAMP '2024-01-01 00:00:10') AS t(ts)")
    found = series.sliding_ratio(spans, "ts", [], F.lit(1).cast("long"), F.lit(1).cast("long"), 15, 300)
    assert found.count() == 22 and found.filter("value = 1").count() == 21


def test_rules_do_not_see_the_future(spark):
    rules = spark.sql("SELECT 's' AS signal, 'a' AS alert_name, 'warning' AS severity, 'd' AS description, '>' AS comparator, 0.5D AS threshold, 0L AS for_seconds, 60L AS step_seconds")
    signals = spark.createDataFrame([("s", "x", 60 * k, 1.0 if k in (3, 8) else 0.0) for k in range(10)], "signal string, series string, tick long, value double")
    found = alerts.evaluate_rules(signals, rules, "1970-01-01 00:05:00").collect()
    assert [str(r.started_at) for r in found] == ["1970-01-01 00:03:00"]
    assert alerts.evaluate_rules(signals, rules, "1970-01-01 00:09:00", since="1970-01-01 00:05:00").count() == 1


def test_embedding_holds_few_vectors_at_a_time(spark, monkeypatch):
    """Every vector is right whatever the piece, a text without words and a missing one too."""
    monkeypatch.setattr(drift, "EMBED_PIECE", 3)
    texts = [" ".join(["w%d" % (k % 5)] * (k % 4) + ["x"] * (k % 3)) for k in range(11)] + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    got = {r.id: (r.slots, r.v) for r in drift.embed_text(df, "t", "v", dims=16).withColumn("slots", drift.token_slots("t", 16)).collect()}
    for slots, vector in got.values():
        counts = [slots.count(k) for k in range(16)]
        norm = sum(c * c for c in counts) ** 0.5 or 1.0
        assert vector == pytest.approx([c / norm for c in counts])
    assert len(got) == 12
