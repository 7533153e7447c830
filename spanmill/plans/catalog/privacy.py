"""Personal-data scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.functions.pii import PATTERNS, card_numbers, pii_items
from spanmill.operators import pii
from spanmill.plans import derived, jobs
from spanmill.plans.catalog.registry import query
from spanmill.plans.catalog.scalars import ITEMS_SQL
from spanmill.plans.catalog.sql import ANSWERS, END, MONTH, with_

AS_OF = derived.AS_OF


def _count(kind: str) -> str:
    return f"len(list_filter(items, lambda i: i.type = '{kind}')) AS {kind}_count"


@query("pii_items", "SELECT doc_id, " + ", ".join(_count(k) for k in ("ssn", "email", "phone"))
       + ", len(items) AS item_count FROM (SELECT doc_id, " + ITEMS_SQL.format("text") + " AS items FROM documents)")
def items(spark, sf):
    def of(kind: str):
        # One lambda per type, made by a call: a default argument would be taken for an index.
        return F.size(F.filter("items", lambda i: i["type"] == kind)).cast("long").alias(f"{kind}_count")

    found = derived.table(spark, sf, "documents").select("doc_id", pii_items("text").alias("items"))
    return found.select("doc_id", of("ssn"), of("email"), of("phone"), F.size("items").cast("long").alias("item_count"))


SCANNED = "scanned AS (SELECT *, " + ITEMS_SQL.format("response") + " AS items FROM answers)"
SCORED = "scored AS (SELECT *, len(items) AS n, least(len(items) * 0.3::DOUBLE, 1.0) AS score FROM scanned)"
PII = [ANSWERS, SCANNED, SCORED]


@query("pii_score", with_(
    "SELECT span_id, n > 0 AS pii_detected, round(score, 6) AS pii_score, "
    "CASE WHEN n > 0 THEN concat('Found ', n, ' PII items') ELSE 'No PII detected' END AS pii_reason FROM scored", *PII))
def score(spark, sf):
    return pii.scan(derived.answers_only(spark, sf)).select("span_id", "pii_detected", "pii_score", "pii_reason")


QUEUE = (
    "queue AS (SELECT trace_id, round(score, 6) AS score, cast(to_json(items) AS varchar) AS detected_items, "
    f"response AS response_text, {END} AS evaluated_at, score >= 0.9 AS resolved, start_time, span_id FROM scored WHERE n > 0 AND score >= 0.5)"
)


@query("pii_triage", with_("SELECT trace_id, score, detected_items, response_text, evaluated_at, false AS resolved FROM queue", *PII, QUEUE))
def triage(spark, sf):
    return pii.triage(derived.answers_only(spark, sf), AS_OF)


@query("pii_pending", with_(
    "SELECT trace_id, score, detected_items, response_text, evaluated_at, resolved FROM "
    "(SELECT * REPLACE (substr(md5(response_text), 1, 1) < '8' AS resolved) FROM queue) WHERE NOT resolved", *PII, QUEUE))
def pending(spark, sf):
    """About half of the queue counts as worked off."""
    queue = pii.triage(derived.answers_only(spark, sf), AS_OF)
    return pii.pending(queue.withColumn("resolved", F.substring(F.md5("response_text"), 1, 1) < "8"))


LUHN = (
    "list_sum(list_transform(string_split(reverse({0}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT "
    "WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0"
)


@query("pii_credit_card",
       "SELECT doc_id, cast(to_json(list_filter(regexp_extract_all(text, '\\b[0-9]{13,16}\\b'), lambda v: " + LUHN.format("v") + ")) AS varchar) AS cards FROM documents")
def credit_card(spark, sf):
    return derived.table(spark, sf, "documents").select("doc_id", F.to_json(card_numbers("text")).alias("cards"))


@query("pii_rate", with_(
    "SELECT date_trunc('hour', start_time) AS hour, model, count(*) AS responses, count(*) FILTER (n > 0) AS detected, "
    "count(*) FILTER (n > 0 AND score >= 0.5) AS flagged, round(avg((n > 0 AND score >= 0.5)::INT), 12) AS flagged_rate FROM scored GROUP BY 1, 2", *PII), digits=12)
def rate(spark, sf):
    return pii.flagged_rate(derived.answers_only(spark, sf), "start_time")


@query("pii_job", with_(
    "SELECT trace_id, score, detected_items, response_text, evaluated_at, false AS resolved FROM queue "
    f"WHERE substr(md5(concat('pii-job', span_id)), 1, 8) < '80000000' AND start_time >= {END} - INTERVAL 30 DAY AND start_time < {END}", *PII, QUEUE))
def job(spark, sf):
    return jobs.pii_job(derived.answers_only(spark, sf), AS_OF, rate=0.5, salt="pii-job", width=MONTH)


def _ranges_sql(pattern: str) -> str:
    """First and last character of every match, from the lengths of what lies between and of the matches."""
    return (
        f"SELECT doc_id, CAST(list_sum(list_transform(gaps[1:i], lambda t: length(t))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda t: length(t))), 0) + 1 AS BIGINT) AS s, "
        f"length(hits[i]) AS n FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits FROM documents), unnest(range(1, len(hits) + 1)) AS t(i)"
    )


@query("redact", with_(
    "SELECT d.doc_id, sha256(coalesce(c.text, d.text)) AS text_sha256, CAST(length(d.text) AS INTEGER) AS n_chars, CAST(coalesce(c.runs, 0) AS INTEGER) AS pii_runs "
    "FROM documents d LEFT JOIN cleaned c USING (doc_id)",
    "ranges AS (" + " UNION ALL ".join(_ranges_sql(p) for p in PATTERNS.values()) + ")",
    "found AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS pos FROM ranges)",
    "chars AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS pos, unnest(string_split(text, '')) AS c FROM documents WHERE doc_id IN (SELECT doc_id FROM found))",
    "marked AS (SELECT c.doc_id, c.pos AS place, c.c AS letter, f.pos IS NOT NULL AS h FROM chars c LEFT JOIN found f ON f.doc_id = c.doc_id AND f.pos = c.pos)",
    "cleaned AS (SELECT doc_id, string_agg(CASE WHEN h THEN '*' ELSE letter END, '' ORDER BY place) AS text, count(*) FILTER (h AND NOT before) AS runs "
    "FROM (SELECT *, coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY place), false) AS before FROM marked) GROUP BY doc_id)"))
def redact(spark, sf):
    """Whole documents, masked in place."""
    clean = pii.redact(derived.table(spark, sf, "documents"), "text")
    return clean.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.length("text").alias("n_chars"), "pii_runs")
