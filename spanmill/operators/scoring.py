"""Scoring of sampled responses: any set of metrics, one long table of scores.

A scorer is a column expression over a response row (question, response, context,
passages, reference), or a Python function run as an Arrow UDF. The lexical scorers here
are this package's own definitions: word-overlap proxies, not a judge model's verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanmill.functions import times
from spanmill.functions.text import let, overlap, ratio, sentences, token_set, tokens
from spanmill.session import counted_copy

LEXICAL_JUDGE = "lexical"
# Our own word list for the lexical toxicity proxy.
TOXIC_WORDS = ("awful", "damn", "dumb", "hate", "idiot", "kill", "loser", "moron", "stupid", "trash")
# Share of a passage's or sentence's words that has to be found for it to count as covered.
COVERED_SHARE = 0.5


def faithfulness(response: str = "response", context: str = "context") -> Column:
    """Share of the response's distinct words that occur in the context."""
    return let(token_set(response), lambda words: ratio(overlap(words, token_set(context)), F.size(words)))


def toxicity(response: str = "response", lexicon: tuple[str, ...] = TOXIC_WORDS) -> Column:
    """Share of the response's words, repeats counted, that are in the lexicon."""
    return let(
        tokens(response), lambda words: ratio(F.size(F.filter(words, lambda w: w.isin(*lexicon))), F.size(words))
    )


def toxicity_by_lexicon(
    df: DataFrame, key: str, lexicon: DataFrame, response: str = "response", broadcast_rows: int = 200_000, salts: int = 64
) -> DataFrame:
    """Toxicity with a lexicon table (``word``) of any size: explode, join, count per key.

    Words are counted per row before the join. A lexicon too large to broadcast is
    repeated per salt, since a common word would otherwise meet all texts in one task.
    """
    words = df.select(key, F.explode_outer(tokens(response)).alias("word"))
    counted = words.groupBy(key, "word").agg(F.count("word").alias("_n"))
    listed, rows, _ = counted_copy(
        lexicon.select(F.lower("word").alias("word")).distinct().withColumn("_listed", F.lit(True)), F.lit(False)
    )
    if rows <= broadcast_rows:
        joined = counted.join(F.broadcast(listed), "word", "left")
    else:
        repeated = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = counted.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
        joined = salted.join(repeated, ["word", "_salt"], "left")
    hits = F.coalesce(F.sum(F.when(F.col("_listed"), F.col("_n"))), F.lit(0))
    return joined.groupBy(key).agg(ratio(hits, F.sum("_n")).alias("toxicity"))


def answer_relevancy(question: str = "question", response: str = "response") -> Column:
    """Cosine of the word sets of question and response."""
    def cosine(a: Column, b: Column) -> Column:
        sizes = F.sqrt((F.size(a) * F.size(b)).cast("double"))
        return F.when((F.size(a) > 0) & (F.size(b) > 0), overlap(a, b) / sizes)

    return let(token_set(question), lambda a: let(token_set(response), lambda b: cosine(a, b)))


def _covered(own: Column, words: Column, share: float) -> Column:
    return (F.size(own) > 0) & (overlap(own, words) >= F.size(own) * F.lit(share))


def context_precision(passages: str = "passages", reference: str = "response", share: float = COVERED_SHARE) -> Column:
    """Mean of precision@k over the ranks k that hold a relevant passage.

    Passages come ranked in an array, so the running count stays inside the row. No
    relevant passage gives 0; no passage gives null.
    """
    start = F.struct(
        F.lit(0).alias("rank"), F.lit(0).alias("hits"), F.lit(0.0).alias("total")
    )

    def step(acc: Column, hit: Column) -> Column:
        hits, rank = acc["hits"] + hit, acc["rank"] + 1
        return F.struct(
            rank.alias("rank"), hits.alias("hits"), (acc["total"] + hit * hits / rank).alias("total")
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["rank"] == 0, F.lit(None)).when(acc["hits"] == 0, F.lit(0.0)).otherwise(
            acc["total"] / acc["hits"]
        )

    own_words = F.transform(passages, lambda p: token_set(p))

    def relevant(words: Column) -> Column:
        return F.transform(own_words, lambda own: F.when(_covered(own, words, share), 1).otherwise(0))

    return let(token_set(reference), lambda words: F.aggregate(relevant(words), start, step, finish))


def context_recall(reference: str = "response", context: str = "context", share: float = COVERED_SHARE) -> Column:
    """Share of the reference's sentences that the context covers."""
    parts = F.transform(sentences(reference), lambda s: token_set(s))

    def covered(words: Column, own: Column) -> Column:
        return ratio(F.size(F.filter(own, lambda o: _covered(o, words, share))), F.size(own))

    return let(token_set(context), lambda words: let(parts, lambda own: covered(words, own)))


LEXICAL_SCORERS = {
    "faithfulness": faithfulness,
    "toxicity": toxicity,
    "answer_relevancy": answer_relevancy,
}
RAG_SCORERS = {"context_precision": context_precision, "context_recall": context_recall}


def python_scorer(make: Callable[[], Callable[..., float]], *columns: str) -> Column:
    """A scorer run in Python: ``make`` loads the model once per task and returns the function.

    A call that raises gives a null score with the error text; other rows go on.
    """

    @F.pandas_udf("score double, error string")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make()
        for batch in batches:
            results = []
            for values in batch.itertuples(index=False, name=None):
                try:
                    results.append((float(score(*values)), None))
                except Exception as error:  # noqa: BLE001 - one bad row must not end the job
                    results.append((None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(results, columns=["score", "error"])

    return run(F.struct(*columns))


def score_responses(
    responses: DataFrame, scorers: dict[str, Column], as_of, judge: str = LEXICAL_JUDGE
) -> DataFrame:
    """One row per response and metric, null score and an error text where a metric failed.

    All column scorers run in the one pass over the responses; nothing is shuffled.
    """
    # Evaluated in their own projection, so that a UDF is called once per row.
    named = {f"_m{i}": column for i, column in enumerate(scorers.values())}
    scored = responses.withColumns(named)
    kinds = dict(scored.dtypes)
    entries = []
    for metric, slot in zip(scorers, named):
        if kinds[slot].startswith("struct"):
            score, error = F.col(slot)["score"], F.col(slot)["error"]
        else:
            score, error = F.col(slot).cast("double"), F.lit(None).cast("string")
        error = F.when(score.isNull(), F.coalesce(error, F.lit("no score")))
        entries.append(
            F.struct(F.lit(metric).alias("metric_name"), score.alias("score"), error.alias("error"))
        )
    reason = F.concat("metric_name", F.lit(" evaluation"))
    return scored.withColumn("_e", F.explode(F.array(*entries))).select(
        "trace_id", "span_id", F.col("parent_span_id"),
        F.col("_e.metric_name").alias("metric_name"), F.col("_e.score").alias("score"),
        F.col("_e.error").alias("error"),
        F.col("provider").alias("evaluated_provider"), F.col("model").alias("evaluated_model"),
    ).select(
        "*", reason.alias("reason"), F.lit(judge).alias("model_used"), times.moment(as_of).alias("evaluated_at")
    )


def kept_scores(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("score").isNotNull()).drop("error")


def failed_scores(scores: DataFrame) -> DataFrame:
    """Metrics that gave no score, with the reason."""
    return scores.filter(F.col("score").isNull()).select(
        "trace_id", "span_id", "metric_name", "error", "evaluated_at"
    )


def union_scores(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
