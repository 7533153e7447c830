"""Plain counterparts of the operators, and small hostile tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: A column name that the operators use themselves.
EXTRA = "part string, kind int, node string, block string, place int, removed string"


def doc_frame(spark, texts, extra=False):
    """``texts`` as documents: (doc_id, text) pairs; with ``extra`` clashing columns too."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    if not extra:
        return spark.createDataFrame(rows, DOC_SCHEMA)
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 2, "w") for r in rows], f"{DOC_SCHEMA}, {EXTRA}")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=5):
    words = space_words(lower_ascii(text))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def jaccard_components(docs, percent=80):
    """doc_id to (size, component) for [(doc_id, text)] with different ids."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def repeats(docs, length=100):
    """doc_id to (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            window = raw[p : p + length]
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int(np.sum(np.diff(gone.astype(int), prepend=0) == 1))
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def gone_lines(docs, max_edits=1, min_chars=20):
    """doc_id to the sorted numbers of its removed lines."""
    first = {}
    for i, text in sorted(docs):
        for no, line in enumerate((text or "").split("\n")):
            if len(line) >= min_chars:
                first.setdefault(line, (i, no))
    near = {r for r in first for s in first if s != r and first[s] < first[r] and abs(len(s) - len(r)) <= max_edits and edits(s, r) <= max_edits}
    return {
        i: [no for no, line in enumerate((text or "").split("\n")) if line in first and (first[line] != (i, no) or line in near)]
        for i, text in docs
    }


def quality_measures(text):
    words = space_words(text)
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p + k for found in places.values() if len(found) > 1 for p in found for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if space_words(line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def contamination(text, items, length=10):
    """(n_words, n_hit, item ids) of a text against [(item_id, text)]."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))
    words, hit, met = split(text), set(), set()
    for item, item_text in items:
        own = split(item_text)
        if not own:
            continue
        size = min(len(own), length)
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                met.add(str(item))
    return len(words), len(hit), sorted(met)
