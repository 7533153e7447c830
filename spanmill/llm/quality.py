"""Quality by weak supervision: rules vote good, bad or abstain, EM weighs them, the posterior decides.

Every rule looks at one measure of the whole text and has two thresholds. ``fit`` runs expectation-maximisation
over the counts of vote patterns of all documents (at most 3 to the power of the number of rules, however large
the corpus), with a table of vote probabilities for each rule and class. A document is kept if it passes the
base checks and its posterior probability of being good reaches the cut.

Edge cases: a null or empty text has no words, fails the base checks and is dropped; rows are judged one by one,
so repeated rows and repeated or null ids get equal verdicts; an empty table gives an empty result; further
columns pass through ``keep_good`` as they are and are ignored by ``measure``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.bytetext import Slice, cover, slices, windows
from spanmill.llm.tasks import in_arrow
from spanmill.session import cut_lineage

#: Name, measure, votes bad at or above, votes good at or below; a measure between abstains.
RULES = (
    ("symbols", "n_symbols / n_words", 0.25, 0.02),
    ("capitals", "capitals / letters", 0.35, 0.15),
    ("shouting", "n_marks / n_words", 0.30, 0.05),
    ("repeats", "n_repeat_words / n_words", 0.35, 0.10),
    ("same_word", "n_same_word / n_words", 0.15, 0.02),
    ("lines", "n_dup_lines / n_lines", 0.40, 0.10),
    ("foreign", "characters other than letters / word_chars", 0.30, 0.15),
    ("long_words", "word_chars / n_words", 13.0, 10.0),
)
MIN_WORDS = 50
CUT = 0.5
FALSE_ALARM, OWN_JUNK = 0.01, 0.9
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _table(characters: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(characters)] = True
    return flags


_SYMBOLS, _MARKS = _table(b"#*$%&|<>"), _table(b"!?")
_CAPITALS = _table(bytes(range(0x41, 0x5B)))
_LETTERS = _CAPITALS | _table(bytes(range(0x61, 0x7B)))
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_BEYOND = np.zeros(256, bool)
_BEYOND[0xC0:] = True


def _slice_measures(s: Slice) -> dict[str, np.ndarray]:
    data = s.data
    starts, ends, owner = s.spans("space")
    hashes = s.hashes(starts, ends)
    n_words = np.bincount(owner, minlength=s.n)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    first, window = windows(hashes, owner, 3)
    repeated = np.zeros(len(hashes), bool)
    if len(first):
        order = np.lexsort((window, owner[first]))
        same = (window[order][1:] == window[order][:-1]) & (owner[first][order][1:] == owner[first][order][:-1])
        twice = np.zeros(len(first), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        repeated = cover(first[twice], first[twice] + 3, len(hashes))
    line_start, line_end, line_owner = s.lines()
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    n_lines = np.bincount(line_owner[worded], minlength=s.n)
    line_hash, line_of = s.hashes(line_start[worded], line_end[worded]), line_owner[worded]
    order = np.lexsort((line_hash, line_of))
    dup = (line_hash[order][1:] == line_hash[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
    same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]) if len(hashes) else np.zeros(0, bool)
    return {
        "n_words": n_words,
        "word_chars": s.counts(_LEAD[data] & inside),
        "n_symbols": s.counts(_SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_of[order][1:][dup], minlength=s.n),
        "n_repeat_words": np.bincount(owner[repeated], minlength=s.n),
        "n_lines": n_lines,
        "n_marks": s.counts(_MARKS[data]),
        "n_same_word": np.bincount(owner[1:][same], minlength=s.n) if len(hashes) else n_words,
        "capitals": s.counts(_CAPITALS[data]),
        "ascii_letters": s.counts(_LETTERS[data]),
        "beyond": s.counts(_BEYOND[data]),
    }


def text_measures(column: pa.Array) -> dict[str, np.ndarray]:
    """All measures of a column of texts."""
    parts = [_slice_measures(s) for s in slices(column)]
    if not parts:
        return {name: np.zeros(0, np.int64) for name in (*MEASURES, "n_lines", "n_marks", "n_same_word", "capitals", "ascii_letters", "beyond")}
    return {name: np.concatenate([p[name] for p in parts]).astype(np.int64) for name in parts[0]}


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One row for each text, one column for each rule: 1 good, 2 bad, 0 abstains."""
    words, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    letters = m["ascii_letters"] + m["beyond"]
    values = (
        m["n_symbols"] / words,
        m["capitals"] / np.maximum(letters, 1),
        m["n_marks"] / words,
        m["n_repeat_words"] / words,
        m["n_same_word"] / words,
        np.where(m["n_lines"] >= 3, m["n_dup_lines"] / np.maximum(m["n_lines"], 1), 0.2),
        1 - np.minimum(letters / chars, 1),
        m["word_chars"] / words,
    )
    return np.stack([np.where(v >= bad, 2, np.where(v <= good, 1, 0)) for v, (_, _, bad, good) in zip(values, RULES, strict=True)], axis=1)


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def encode(cast: np.ndarray) -> np.ndarray:
    return cast @ (3 ** np.arange(len(RULES)))


def decode(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(RULES)) % 3


@dataclass(frozen=True)
class LabelModel:
    """``shares`` of the classes and ``chances[class][rule][vote]``; class 0 is good, class j + 1 is the junk of rule j."""

    shares: np.ndarray
    chances: np.ndarray

    def responsibilities(self, cast: np.ndarray) -> np.ndarray:
        """Probability of each class (columns) for each row of votes."""
        rules = np.arange(len(RULES))
        logs = np.stack([np.log(share) + np.log(table[rules, cast]).sum(1) for share, table in zip(self.shares, self.chances, strict=True)], 1)
        logs = np.exp(logs - logs.max(1, keepdims=True, initial=-np.inf))
        return logs / logs.sum(1, keepdims=True)

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        """Probability of being good of each row of votes."""
        return self.responsibilities(cast)[:, 0]

    def accuracies(self) -> dict[str, float]:
        """How often each rule is right when it votes."""
        junk = np.tensordot(self.shares[1:], self.chances[1:], 1)
        good = self.shares[0] * self.chances[0]
        right, all_ = good[:, 1] + junk[:, 2], (good + junk)[:, 1:].sum(1)
        return {name: float(r / a) for (name, *_), r, a in zip(RULES, right, all_, strict=True)}


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """Expectation-maximisation over vote patterns and how many documents show each.

    Kinds of junk exclude each other, so bad is not one class but one for each rule, started from the texts
    that rule calls bad. Two bounds keep the classes what their names say, whatever the corpus holds: a rule
    calls at most ``FALSE_ALARM`` of the good class bad, and at least ``OWN_JUNK`` of its own class.
    Pseudo-counts keep every chance inside (0, 1); without documents they are the model.
    """
    cast, counts = decode(np.asarray(patterns, np.int64)), np.asarray(counts, float)
    bad = cast == 2
    n_rules = len(RULES)
    weights = np.zeros((len(cast), 1 + n_rules))
    weights[:, 0] = 0.1 ** bad.sum(1)
    weights[:, 1:] = bad * ((1 - weights[:, :1]) / np.maximum(bad.sum(1, keepdims=True), 1))
    own = np.arange(n_rules)
    for _ in range(rounds):
        mass = counts[:, None] * weights
        shares = mass.sum(0) + np.array([10.0] + [0.5] * n_rules)
        shares /= shares.sum()
        chances = np.empty((1 + n_rules, n_rules, 3))
        for vote in range(3):
            chances[:, :, vote] = mass.T @ (cast == vote) + (0.05, 1.0, 0.05)[vote]
        chances /= chances.sum(2, keepdims=True)
        limit = np.minimum(chances[0, :, 2], FALSE_ALARM)
        chances[0, :, :2] *= ((1 - limit) / (1 - chances[0, :, 2]))[:, None]
        chances[0, :, 2] = limit
        floor = np.maximum(chances[own + 1, own, 2], OWN_JUNK)
        chances[own + 1, own, :2] *= ((1 - floor) / (1 - chances[own + 1, own, 2]))[:, None]
        chances[own + 1, own, 2] = floor
        model = LabelModel(shares, chances)
        before, weights = weights, model.responsibilities(cast)
        if np.abs(weights - before).max(initial=0) < tolerance:
            break
    return model


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and the vote pattern of every row of ``docs`` (doc_id, text)."""
    schema = "doc_id bigint, " + ", ".join(f"{name} bigint" for name in MEASURES) + ", base_failed boolean, pattern bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = text_measures(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(m[name]) for name in MEASURES), pa.array(base_failed(m)), pa.array(encode(votes(m)))],
                names=["doc_id", *MEASURES, "base_failed", "pattern"],
            )

    return in_arrow(docs.select("doc_id", "text"), run, schema)


def fit_patterns(measured: DataFrame) -> tuple[LabelModel, np.ndarray, np.ndarray]:
    """The model of all rows of ``measured``, its patterns and their posteriors (at most 3 ** rules)."""
    rows = measured.groupBy("pattern").count().collect()
    patterns = np.array(sorted(r["pattern"] for r in rows), np.int64)
    counts = np.array([r["count"] for r in sorted(rows, key=lambda r: r["pattern"])], float)
    model = fit(patterns, counts)
    return model, patterns, model.posterior(decode(patterns))


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """The measures, the posterior probability of quality and the verdict of every row of ``docs``."""
    measured = cut_lineage(measure(docs))
    _, patterns, posterior = fit_patterns(measured)
    spark = docs.sparkSession
    known = spark.createDataFrame([(int(p), float(x)) for p, x in zip(patterns, posterior, strict=True)], "pattern bigint, posterior double")
    return measured.join(F.broadcast(known), "pattern").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= cut))


def keep_good(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The votes are counted in a first pass; the second judges each row beside its columns, so no text is shuffled.
    """
    _, patterns, posterior = fit_patterns(measure(docs))
    good = patterns[posterior >= cut]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = text_measures(batch.column("text"))
            kept = np.isin(encode(votes(m)), good) & ~base_failed(m)
            yield batch.filter(pa.array(kept))

    return in_arrow(docs, run, docs.schema)
