"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are the runs of letters, digits and characters beyond ASCII, A-Z in lower case. The automaton of all items'
word sequences is built on the driver (``ITEM_WORDS`` words at most; more items make several automata, and documents
pass through one after the other) and handed to the tasks. Each document's words run through it once, the length of
the longest match that ends at each word is tracked, and a word is hit if it lies in a match of ``length`` words or
in a whole item of fewer words. Only stretches of known words that could hold a match are stepped through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.bytetext import Slice, cover, slices
from spanmill.llm.tasks import Batches, in_arrow

LENGTH = 10
#: Words of the items of one automaton; bounds what is built on the driver and sent to the tasks.
ITEM_WORDS = 2_000_000
#: A document is dropped by ``decontaminate`` if hit words are more than this share of it.
COVERAGE = 0.8


class SuffixAutomaton:
    """All substrings of several word sequences; every state knows the items of its matches of the tracked length."""

    def __init__(self, items: list[tuple[str | None, list[int]]], length: int):
        self.length = length
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        #: By state: the state of the last ``length`` words of any match there, or -1.
        self.window = [self._ancestor(v, length) for v in range(len(self.size))]
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        self.shortest = length
        whole: dict[int, dict[int, set[str]]] = {}
        for name, words in items:
            named = set() if name is None else {name}
            if 0 < len(words) < length:
                state = 0
                for word in words:
                    state = self.next[state][word]
                whole.setdefault(self._ancestor(state, len(words)), {}).setdefault(len(words), set()).update(named)
                self.shortest = min(self.shortest, len(words))
            else:
                for at, state, match in self.run(words):
                    if match >= length:
                        self.items.setdefault(self.window[state], set()).update(named)
        if whole:
            for state in range(len(self.size)):
                found, up = [], state
                while up > 0:
                    found += whole.get(up, {}).items()
                    up = self.link[up]
                if found:
                    self.short[state] = found

    def _extend(self, last: int, word: int) -> int:
        link, size, nxt = self.link, self.size, self.next
        if word in nxt[last]:
            old = nxt[last][word]
            return old if size[old] == size[last] + 1 else self._clone(last, word, old)
        new = len(size)
        size.append(size[last] + 1)
        nxt.append({})
        link.append(0)
        up = last
        while up >= 0 and word not in nxt[up]:
            nxt[up][word] = new
            up = link[up]
        if up >= 0:
            old = nxt[up][word]
            link[new] = old if size[old] == size[up] + 1 else self._clone(up, word, old)
        return new

    def _clone(self, up: int, word: int, old: int) -> int:
        copy = len(self.size)
        self.size.append(self.size[up] + 1)
        self.next.append(dict(self.next[old]))
        self.link.append(self.link[old])
        self.link[old] = copy
        while up >= 0 and self.next[up].get(word) == old:
            self.next[up][word] = copy
            up = self.link[up]
        return copy

    def _ancestor(self, state: int, length: int) -> int:
        """The state on the suffix path of ``state`` whose words of this length are a suffix of it, or -1."""
        if self.size[state] < length:
            return -1
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def run(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length of the longest match that ends there) for every word."""
        state = match = 0
        nxt, link, size = self.next, self.link, self.size
        for at, word in enumerate(words):
            to = nxt[state].get(word)
            while to is None and state:
                state = link[state]
                match = size[state]
                to = nxt[state].get(word)
            if to is None:
                match = 0
            else:
                state, match = to, match + 1
            yield at, state, match

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(start, end, items) of every match of the tracked length and every whole shorter item."""
        length, window, items, short = self.length, self.window, self.items, self.short
        for at, state, match in self.run(words):
            if match >= length:
                yield at + 1 - length, at + 1, items[window[state]]
            for size, named in short.get(state, ()):
                if size <= match:
                    yield at + 1 - size, at + 1, named


class ItemIndex:
    """An automaton with its vocabulary: sorted hashes of the items' words."""

    def __init__(self, items: list[tuple[str | None, str | None]], length: int):
        texts = pa.array([text for _, text in items], pa.string())
        hashes, owners = [], []
        for s in slices(texts):
            found, owner = word_hashes(s)[2:]
            hashes.append(found)
            owners.append(owner + s.first)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        self.words = np.unique(every)
        ids = np.searchsorted(self.words, every)
        cuts = np.searchsorted(owner, np.arange(len(items) + 1))
        self.automaton = SuffixAutomaton([(items[i][0], ids[cuts[i] : cuts[i + 1]].tolist()) for i in range(len(items))], length)

    def hits(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
        """Starts, ends, text numbers and hit flags of the words of ``s``, and the items met in each text."""
        starts, ends, hashes, owner = word_hashes(s)
        met: list[set[str]] = [set() for _ in range(s.n)]
        hit = np.zeros(len(hashes), bool)
        if len(self.words) and len(hashes):
            ids = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[ids] == hashes
            edge = np.ones(len(known) + 1, bool)
            edge[1:-1] = (known[1:] != known[:-1]) | (owner[1:] != owner[:-1])
            cuts = np.flatnonzero(edge)
            runs = np.flatnonzero(known[cuts[:-1]] & (np.diff(cuts) >= self.automaton.shortest))
            for begin, end in zip(cuts[runs].tolist(), cuts[runs + 1].tolist(), strict=True):
                text = int(owner[begin])
                for start, stop, items in self.automaton.matches(ids[begin:end].tolist()):
                    hit[begin + start : begin + stop] = True
                    met[text] |= items
        return starts, ends, owner, hit, met


def word_hashes(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s = s.lower()
    starts, ends, owner = s.spans("alnum")
    return starts, ends, s.hashes(starts, ends), owner


def item_indexes(benchmark: DataFrame, length: int = LENGTH) -> list[ItemIndex]:
    """Automata of all items of ``benchmark`` (item_id, text), each of at most ``ITEM_WORDS`` words or one item."""
    sized = benchmark.select(F.col("item_id").cast("string").alias("item"), "text", (F.length(F.coalesce("text", F.lit(""))) / 2 + 1).alias("most"))
    shares = int(sized.agg(F.sum("most")).first()[0] or 0) // ITEM_WORDS + 1
    dealt = sized.withColumn("share", F.pmod(F.xxhash64("item", "text"), F.lit(shares)))
    return [
        ItemIndex([(r["item"], r["text"]) for r in dealt.filter(F.col("share") == share).select("item", "text").collect()], length)
        for share in range(shares)
    ]


def _shared(spark, index: ItemIndex):
    return spark.sparkContext.broadcast(index)


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs`` (doc_id, text).

    n_items counts the different item_ids of which a window (``length`` words, or the whole of a shorter item) occurs;
    items_sha256 is the digest of those ids, sorted as strings and joined by commas.

    Edge cases: null and empty texts have no words and are not contaminated; items without words match nothing; items
    without an id are matched but not counted; repeated rows are judged one by one; an empty benchmark hits nothing;
    an empty table gives an empty result. Other columns are ignored.
    """
    indexes = [_shared(docs.sparkSession, index) for index in item_indexes(benchmark, length)]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in ("n_words", "n_hit", "n_items", "items_sha256")}
            for s in slices(batch.column("text")):
                flags, met = None, [set() for _ in range(s.n)]
                for index in indexes:
                    _, _, owner, hit, items = index.value.hits(s)
                    flags = hit if flags is None else flags | hit
                    met = [a | b for a, b in zip(met, items, strict=True)]
                columns["n_words"] += np.bincount(owner, minlength=s.n).tolist()
                columns["n_hit"] += np.bincount(owner[flags], minlength=s.n).tolist()
                columns["n_items"] += [len(m) for m in met]
                columns["items_sha256"] += [hashlib.sha256(",".join(sorted(m)).encode()).hexdigest() for m in met]
            found = pa.array(columns["n_hit"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns["n_words"], pa.int64()), found, pa.array(columns["n_items"], pa.int64()), pa.array(columns["items_sha256"], pa.string()), pa.array(np.array(columns["n_hit"], np.int64) > 0)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without hit spans: same columns, ``text`` shortened from the first to the last word of each span.

    A document of which more than ``coverage`` of the words are hit goes; all others stay, without hits unchanged.
    A null text stays null. See ``contamination`` for the edge cases.
    """
    indexes = [_shared(docs.sparkSession, index) for index in item_indexes(benchmark, length)]
    place = docs.columns.index("text")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            column = batch.column(place)
            texts, stays, changed = column.to_pylist(), np.ones(len(batch), bool), False
            for s in slices(column):
                flags = None
                for index in indexes:
                    starts, ends, owner, hit, _ = index.value.hits(s)
                    flags = hit if flags is None else flags | hit
                total, hits = np.bincount(owner, minlength=s.n), np.bincount(owner[flags], minlength=s.n)
                for text in np.flatnonzero(hits):
                    changed = True
                    if hits[text] > coverage * total[text]:
                        stays[s.first + text] = False
                        continue
                    begin, end = np.searchsorted(owner, [text, text + 1])
                    edges = np.diff(np.concatenate([[0], flags[begin:end].view(np.int8), [0]]))
                    low, raw = int(s.bounds[text]), s.data[s.bounds[text] : s.bounds[text + 1]]
                    first, last = starts[begin:end][edges[:-1] == 1] - low, ends[begin:end][edges[1:] == -1] - low
                    texts[s.first + text] = raw[~cover(first, last, len(raw))].tobytes().decode()
            if changed:
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, column.type)).filter(pa.array(stays))
            yield batch

    return in_arrow(docs, run, docs.schema)
