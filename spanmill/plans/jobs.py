"""The periodic jobs. Each is one plan from its input to the rows it stores.

An empty input gives an empty result. ``store`` appends it; an outside scheduler starts
the job (every 15 minutes for scoring, weekly for drift).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from spanmill.functions import sampling
from spanmill.operators import alerts, drift, pii, scoring, search
from spanmill.operators.latest import latest_per_key
from spanmill.schemas import ALERT_HISTORY, DRIFT_SCORES, EVALS, PII_QUEUE
from spanmill.session import cut_lineage
from spanmill.sources.facts import append_table


def eval_job(
    spans: DataFrame, as_of, scorers: dict[str, Column] | None = None, rate: float = sampling.SCORING_RATE,
    limit: int | None = None, salt: str = "", **width: int,
) -> DataFrame:
    """Recent client spans, a share of them, every metric, one row per (trace, span, metric).

    All of them by default; ``limit`` takes the newest.
    """
    recent = search.recent_client_spans(spans, as_of, limit, **width)
    return _score(recent, as_of, scorers or {m: f() for m, f in scoring.LEXICAL_SCORERS.items()}, rate, salt)


def rag_job(
    spans: DataFrame, as_of, scorers: dict[str, Column] | None = None, rate: float = sampling.RAG_RATE,
    limit: int | None = None, salt: str = "", **width: int,
) -> DataFrame:
    """The same over spans of retrieval services, with the retrieval metrics."""
    recent = search.rag_spans(spans, as_of, limit, **width)
    return _score(recent, as_of, scorers or {m: f() for m, f in scoring.RAG_SCORERS.items()}, rate, salt)


def _score(recent: DataFrame, as_of, scorers: dict[str, Column], rate: float, salt: str) -> DataFrame:
    sampled = search.hash_sample(recent, "span_id", rate, salt)
    scores = scoring.kept_scores(scoring.score_responses(sampled, scorers, as_of))
    return latest_per_key(scores, ["trace_id", "span_id", "metric_name"], "evaluated_at")


def pii_job(
    spans: DataFrame, as_of, rate: float = sampling.PII_RATE, limit: int | None = None, salt: str = "",
    text: str = "response", width: dict | None = None, **options,
) -> DataFrame:
    """Recent client spans, a share of them, scanned; queue rows of the flagged ones."""
    recent = search.recent_client_spans(spans, as_of, limit, **(width or {}))
    return pii.triage(search.hash_sample(recent, "span_id", rate, salt), as_of, text, **options)


def drift_job(prompts: DataFrame, as_of, text: str = "prompt", ts: str = "start_time", dims: int = drift.DIMENSIONS) -> DataFrame:
    """Embed the prompts of both periods, compare them per dimension, rows of the drift table.

    The vectors are written before they are compared: ranges and histograms read them in
    two passes, and embedding is the costly part.
    """
    sides = drift.baseline_current_split(prompts, ts, as_of).select("side", text)
    vectors = cut_lineage(drift.embed_text(sides, text, dims=dims).select("side", "embedding"))
    return drift.score_rows(drift.drift_by_dimension(vectors), as_of)


def alert_job(signals: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    """All rules over all signals, as history rows."""
    return alerts.alert_history(alerts.evaluate_rules(signals, rules, as_of))


def store_scores(scores: DataFrame, path: str, as_of=None) -> None:
    append_table(scores, path, EVALS, "evaluated_at", as_of)


def store_queue(rows: DataFrame, path: str, as_of=None) -> None:
    append_table(rows, path, PII_QUEUE, "evaluated_at", as_of)


def store_drift(rows: DataFrame, path: str, as_of=None) -> None:
    append_table(rows, path, DRIFT_SCORES, "score_date", as_of)


def store_alerts(rows: DataFrame, path: str, as_of=None) -> None:
    append_table(rows, path, ALERT_HISTORY, "fired_at", as_of)
