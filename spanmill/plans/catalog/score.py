"""Response scoring with the lexical scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import drift, scoring
from spanmill.plans import derived, jobs
from spanmill.plans.catalog.registry import query
from spanmill.plans.catalog.sql import ANSWERS, END, MONTH, RESPONSES, SENTENCES, WORD_SET, WORDS, with_

AS_OF = derived.AS_OF
LEXICON = ", ".join(f"'{w}'" for w in scoring.TOXIC_WORDS)
# The given texts are made-up syllables, so coverage is rare at the default share.
SHARE = 0.25

SETS = (
    f"sets AS (SELECT *, {WORD_SET.format('response')} AS rw, {WORD_SET.format('question')} AS qw, {WORD_SET.format('context')} AS cw, "
    f"{WORDS.format('response')} AS rt FROM responses)"
)
FAITHFUL = "CASE WHEN len(rw) > 0 THEN len(list_intersect(rw, cw)) / len(rw) END"
TOXIC = f"CASE WHEN len(rt) > 0 THEN len(list_filter(rt, lambda w: list_contains([{LEXICON}], w))) / len(rt) END"
RELEVANT = "CASE WHEN len(rw) > 0 AND len(qw) > 0 THEN len(list_intersect(qw, rw)) / sqrt(len(qw) * len(rw)) END"
SCORES = (
    "scores AS (SELECT trace_id, span_id, 'faithfulness' AS metric_name, " + FAITHFUL + " AS score, provider, model, start_time FROM sets "
    "UNION ALL SELECT trace_id, span_id, 'toxicity', " + TOXIC + ", provider, model, start_time FROM sets "
    "UNION ALL SELECT trace_id, span_id, 'answer_relevancy', " + RELEVANT + ", provider, model, start_time FROM sets)"
)
OUT = ["trace_id", "span_id", "metric_name", "score", "evaluated_provider", "evaluated_model"]
OUT_SQL = "trace_id, span_id, metric_name, round(score, 12) AS score, provider AS evaluated_provider, model AS evaluated_model"


@query("score_responses", with_(f"SELECT {OUT_SQL}, 'lexical' AS model_used, {END} AS evaluated_at FROM scores", RESPONSES, SETS, SCORES), digits=12)
def score_responses(spark, sf):
    scorers = {name: make() for name, make in scoring.LEXICAL_SCORERS.items()}
    return scoring.score_responses(derived.responses(spark, sf), scorers, AS_OF).select(*OUT, "model_used", "evaluated_at")


@query("faithfulness", with_(f"SELECT span_id, round({FAITHFUL}, 12) AS score FROM sets", RESPONSES, SETS), digits=12)
def faithfulness(spark, sf):
    return derived.responses(spark, sf).select("span_id", scoring.faithfulness().alias("score"))


# A word list out of the data itself: every word of the benchmark items.
BENCH_WORDS = f"lexicon AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS word FROM benchmark)"


@query("toxicity", with_(
    "SELECT doc_id, round(count(l.word) / nullif(count(w), 0), 12) AS score FROM "
    f"(SELECT doc_id, unnest(CASE WHEN len({WORDS.format('text')}) = 0 THEN [NULL] ELSE {WORDS.format('text')} END) AS w FROM documents) d "
    "LEFT JOIN lexicon l ON l.word = d.w GROUP BY doc_id", BENCH_WORDS), digits=12)
def toxicity(spark, sf):
    """Against a lexicon table, over whole documents."""
    lexicon = derived.table(spark, sf, "benchmark").select(F.explode(scoring.tokens("text")).alias("word"))
    scored = scoring.toxicity_by_lexicon(derived.table(spark, sf, "documents"), "doc_id", lexicon, "text")
    return scored.withColumnRenamed("toxicity", "score")


@query("answer_relevancy", with_(f"SELECT span_id, round({RELEVANT}, 12) AS score FROM sets", RESPONSES, SETS), digits=12)
def answer_relevancy(spark, sf):
    return derived.responses(spark, sf).select("span_id", scoring.answer_relevancy().alias("score"))


PASSAGES = (
    f"passages AS (SELECT span_id, rw, unnest({SENTENCES.format('context')}) AS p, "
    f"generate_subscripts({SENTENCES.format('context')}, 1) AS k FROM sets)"
)
PRECISION = (
    "precision_at AS (SELECT span_id, k, hit, sum(hit) OVER (PARTITION BY span_id ORDER BY k) AS hits FROM "
    f"(SELECT span_id, k, CASE WHEN len(pw) > 0 AND len(list_intersect(pw, rw)) >= len(pw) * {SHARE}::DOUBLE THEN 1 ELSE 0 END AS hit "
    f"FROM (SELECT *, {WORD_SET.format('p')} AS pw FROM passages)))"
)
PRECISION_SQL = (
    "SELECT s.span_id, round(max(CASE WHEN t.n IS NULL THEN NULL WHEN t.h = 0 THEN 0 ELSE t.total / t.h END), 12) AS score FROM sets s LEFT JOIN "
    "(SELECT span_id, count(*) AS n, sum(hit) AS h, sum(hit * hits / k) AS total FROM precision_at GROUP BY span_id) t USING (span_id) GROUP BY s.span_id"
)


@query("context_precision", with_(PRECISION_SQL, RESPONSES, SETS, PASSAGES, PRECISION), digits=12)
def context_precision(spark, sf):
    return derived.responses(spark, sf).select("span_id", scoring.context_precision(share=SHARE).alias("score"))


RECALL = (
    f"CASE WHEN len(rs) > 0 THEN len(list_filter(rs, lambda s: len(list_intersect(list_distinct({WORDS.format('s')}), cw)) "
    f">= len(list_distinct({WORDS.format('s')})) * {SHARE}::DOUBLE)) / len(rs) END"
)


@query("context_recall", with_(
    f"SELECT span_id, round({RECALL}, 12) AS score FROM (SELECT *, {SENTENCES.format('response')} AS rs FROM sets)", RESPONSES, SETS), digits=12)
def context_recall(spark, sf):
    return derived.responses(spark, sf).select("span_id", scoring.context_recall(share=SHARE).alias("score"))


@query("eval_job", with_(
    f"SELECT {OUT_SQL} FROM scores WHERE start_time >= {END} - INTERVAL 30 DAY AND start_time < {END} "
    "AND substr(md5(span_id), 1, 8) < '26666667' AND score IS NOT NULL", RESPONSES, SETS, SCORES), digits=12)
def eval_job(spark, sf):
    return jobs.eval_job(derived.responses(spark, sf), AS_OF, limit=None, **MONTH).select(*OUT)


@query("rag_job", with_(
    "SELECT p.span_id, 'context_precision' AS metric_name, p.score FROM (" + PRECISION_SQL + ") p JOIN sets s USING (span_id) "
    f"WHERE s.start_time >= {END} - INTERVAL 30 DAY AND s.start_time < {END} AND s.service_name <> 'chat-svc' "
    "AND substr(md5(span_id), 1, 8) < '33333334' AND p.score IS NOT NULL UNION ALL "
    f"SELECT span_id, 'context_recall', round({RECALL}, 12) AS score FROM (SELECT *, {SENTENCES.format('response')} AS rs FROM sets) "
    f"WHERE start_time >= {END} - INTERVAL 30 DAY AND start_time < {END} AND service_name <> 'chat-svc' "
    f"AND substr(md5(span_id), 1, 8) < '33333334' AND {RECALL} IS NOT NULL", RESPONSES, SETS, PASSAGES, PRECISION), digits=12)
def rag_job(spark, sf):
    scorers = {name: make(share=SHARE) for name, make in scoring.RAG_SCORERS.items()}
    return jobs.rag_job(derived.responses(spark, sf), AS_OF, scorers, limit=None, **MONTH).select("span_id", "metric_name", "score")


def _strict_length():
    def score(response: str) -> float:
        if "SSN" in response:
            raise ValueError("refused")
        return len(response) / (len(response) + 1000)

    return score


@query("score_failures", with_(
    "SELECT span_id, 'length' AS metric_name, CASE WHEN contains(response, 'SSN') THEN NULL "
    "ELSE round(length(response) / (length(response) + 1000), 12) END AS score, "
    "CASE WHEN contains(response, 'SSN') THEN 'ValueError: refused' END AS error FROM answers "
    f"UNION ALL SELECT span_id, 'words', round(len({WORDS.format('response')})::DOUBLE, 12), NULL FROM answers", ANSWERS), digits=12)
def score_failures(spark, sf):
    """One metric raises on some rows; the other metric and the other rows are kept."""
    scorers = {
        "length": scoring.python_scorer(_strict_length, "response"),
        "words": F.size(scoring.tokens("response")).cast("double"),
    }
    return scoring.score_responses(derived.answers_only(spark, sf), scorers, AS_OF).select("span_id", "metric_name", "score", "error")


def _two_numbers():
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


@query("plug_embedder", with_(
    "SELECT span_id, length(response)::DOUBLE AS v0, (length(response) - length(replace(response, ' ', '')))::DOUBLE AS v1 FROM answers", ANSWERS))
def plug_embedder(spark, sf):
    """Any embedding function, loaded once per task."""
    embedded = drift.embed_with(derived.answers_only(spark, sf), "response", _two_numbers)
    return embedded.select("span_id", F.get("embedding", F.lit(0)).cast("double").alias("v0"), F.get("embedding", F.lit(1)).cast("double").alias("v1"))


def _share_of_spaces():
    return lambda question, response: question.count(" ") / (1 + len(response))


@query("plug_scorer", with_(
    "SELECT span_id, round((length(question) - length(replace(question, ' ', ''))) / (1 + length(response)), 12) AS score FROM responses", RESPONSES), digits=12)
def plug_scorer(spark, sf):
    """Any Python function as a scorer."""
    scorers = {"spaces": scoring.python_scorer(_share_of_spaces, "question", "response")}
    return scoring.score_responses(derived.responses(spark, sf), scorers, AS_OF).select("span_id", "score")
