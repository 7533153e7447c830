"""SQL building blocks of the counterparts: the derived tables as CTEs."""

from __future__ import annotations

from spanmill.plans.derived import AS_OF, LEAKED, RESPONSE_EXPRS, SPAN_EXPRS
from spanmill.sources.pricing import SEED

END = f"TIMESTAMP '{AS_OF}'"
# The catalogue's windows: traffic in the given tables is too thin for minutes.
WEEK = {"days": 7}
MONTH = {"days": 30}
IN_WEEK = f"start_time >= {END} - INTERVAL 7 DAY AND start_time < {END}"
EVAL_IN_MONTH = f"evaluated_at >= {END} - INTERVAL 30 DAY AND evaluated_at < {END}"

SPANS = "spans AS (SELECT " + ", ".join(SPAN_EXPRS) + " FROM events)"
PRICING = (
    "pricing AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{m}', '{p}', {i!r}::DOUBLE, {o!r}::DOUBLE)" for m, p, i, o in SEED)
    + ") AS t(model_name, provider, input_price, output_price))"
)
CANONICAL = (
    "regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '^.*/', '')), "
    "'-([0-9]{{8}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})$', ''), '-instruct$', ''), "
    "'^claude-([0-9])-([0-9])-', 'claude-\\1.\\2-')"
)
PRICED = (
    "priced AS (SELECT s.*, "
    "input_tokens / 1000.0::DOUBLE * coalesce(p.input_price, m.input_price) "
    "+ output_tokens / 1000.0::DOUBLE * coalesce(p.output_price, m.output_price) AS cost_usd "
    f"FROM (SELECT *, {CANONICAL.format('model')} AS price_key FROM spans) s "
    "LEFT JOIN pricing p ON p.provider = s.provider AND p.model_name = s.price_key "
    "LEFT JOIN (SELECT model_name, arg_min(input_price, provider) AS input_price, "
    "arg_min(output_price, provider) AS output_price FROM pricing GROUP BY model_name) m "
    "ON m.model_name = s.price_key)"
)
RAW_EVALS = f"""raw_evals AS (
  SELECT md5(concat('t', doc_id)) AS trace_id, substr(md5(concat('s', doc_id * 4)), 1, 16) AS span_id,
    metric_name, score,
    CASE doc_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-3.5-sonnet' ELSE 'gemini-2.0-flash' END AS evaluated_model,
    {END} - INTERVAL 1 DAY * (doc_id % 40) - INTERVAL 1 MINUTE AS evaluated_at,
    {END} - INTERVAL 1 DAY * (doc_id % 40) + INTERVAL 1 MINUTE * ver AS inserted_at, ver, doc_id
  FROM (
    SELECT doc_id, m.metric_name, v.ver,
      CASE WHEN m.metric_name = 'toxicity' THEN cast(toxic AS double)
        ELSE round(cast(0.4 + 0.5 * quality + (doc_id % 10) / 100.0 - 0.2 * v.ver * (doc_id % 2) AS double), 4) END AS score
    FROM labels
    CROSS JOIN (VALUES ('faithfulness'), ('toxicity'), ('answer_relevancy')) AS m(metric_name)
    CROSS JOIN (VALUES (0), (1)) AS v(ver)
    WHERE v.ver = 0 OR doc_id % 5 = 0
    UNION ALL
    SELECT doc_id, concat('toxicity_', CASE doc_id % 3 WHEN 0 THEN 'insult' WHEN 1 THEN 'threat' ELSE 'profanity' END),
      0, cast(toxic * 0.5 + (doc_id % 10) / 100.0 AS double)
    FROM labels))"""
EVALS = RAW_EVALS + """, evals AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY trace_id, metric_name ORDER BY inserted_at DESC, span_id DESC) AS rn
    FROM raw_evals) WHERE rn = 1)"""
ANSWERS = (
    "answers AS (SELECT " + ", ".join(RESPONSE_EXPRS)
    + f", {LEAKED} AS response FROM conversations WHERE role = 'assistant')"
)
WORDS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
WORD_SET = "list_distinct(" + WORDS + ")"
SENTENCES = "list_filter(string_split_regex({0}, '[.!?\\n]+'), lambda s: regexp_matches(s, '[\\p{{L}}\\p{{N}}]'))"
RESPONSES = ANSWERS + """, responses AS (
  SELECT a.*, coalesce(q.text, '') AS question,
    concat(coalesce(q.text, ''), chr(10), coalesce(d.text, '')) AS context
  FROM answers a
  LEFT JOIN conversations q ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn
  LEFT JOIN documents d ON d.doc_id = a.conv_id)"""


def with_(body: str, *ctes: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ", ".join(ctes) + " " + body


def on_spans(body: str, *more: str) -> str:
    return with_(body, SPANS, *more)


def on_priced(body: str, *more: str) -> str:
    return with_(body, SPANS, PRICING, PRICED, *more)


def on_evals(body: str, *more: str) -> str:
    return with_(body, EVALS, *more)
