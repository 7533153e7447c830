"""Token ids of whole texts by the ``tokenizers`` library, with a table of pieces between spaces.

A tokenizer's pre-tokenization never joins letters across a space, so the ids of a text are the ids of its pieces,
one after the other; where runs of white space could be taken together, the whole text is encoded at once. The pieces
of a column are told apart by Arrow, only different ones are looked up, and only new ones are tokenized. A worker
keeps the first ``CACHED`` pieces that it meets.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spanmill.llm.bytetext import ranges

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHED = 400_000
#: Three white-space characters, or two at the end, may be one token. (The class is a superset of any library's.)
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_JOINED = f"{_SPACE}{_SPACE}(?:{_SPACE}|\\z)"
_ENDS = tuple(".,;:!?")


class Encoder:
    """``keeps_space``: byte-level BPE that keeps white space; otherwise white space is dropped, only separates, and case does not count."""

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keeps_space = keeps_space
        #: Pieces with their ids: as they stand, and after a space.
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _tokenize(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, 32 bits each."""
        if not pieces:
            return []
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        flat = np.array(list(chain.from_iterable(encoded)), np.uint32).tobytes()
        ends = (4 * np.cumsum([len(e) for e in encoded])).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _lookup(self, pieces: list[str], spaced: bool) -> list[bytes]:
        """The ids of different pieces, each as it stands or after a space; one that begins a line has none."""
        known = self.spaced if spaced else self.known
        found = list(map(known.get, pieces))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            # A letter and one sign at the end are always two pieces to the tokenizer.
            split = {i: p[:-1] for i in missing if len(p := pieces[i]) > 2 and p[-1] in _ENDS and p[-2].isalpha()}
            asked = dict.fromkeys(split.get(i, pieces[i]) for i in missing)
            new = [p for p in asked if p not in known]
            fresh = dict(zip(new, self._tokenize([p if p[:1] == "\n" else " " + p for p in new] if spaced else new), strict=True))
            signs = dict(zip(_ENDS, self._tokenize(list(_ENDS)), strict=True)) if split else {}
            for i in missing:
                stem = split.get(i, pieces[i])
                ids = known[stem] if stem in known else fresh[stem]
                found[i] = ids + signs[pieces[i][-1]] if i in split else ids
            if len(known) < CACHED:
                known.update(fresh)
                known.update((pieces[i], found[i]) for i in split)
        return found

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts of a column, one after the other, and how many each text has; null is empty."""
        texts = column.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = np.zeros(len(texts), bool)
        if self.keeps_space:
            whole = pc.match_substring_regex(texts, _JOINED).to_numpy(zero_copy_only=False)
            empty = whole | (pc.binary_length(texts).to_numpy() == 0)
            # A piece stands for a space and itself, unless it begins with a line break or the text.
            split = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(empty), "", texts), "\n", " \n"), " ")
        else:
            split = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        # No piece holds a space, so one text of all of them is the quick way out of Arrow.
        different = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        pieces = pc.binary_join(different, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        if self.keeps_space:
            # The first piece of a text has no space before it.
            heads, head_codes = np.unique(codes[bounds[:-1]], return_inverse=True)
            table = self._lookup(pieces, True) + self._lookup([pieces[h] for h in heads], False)
            codes[bounds[:-1]] = len(pieces) + head_codes
        else:
            table = self._lookup(pieces, False)
        lengths = np.fromiter(map(len, table), np.int64, len(table)) >> 2
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(table), np.uint32)
        sizes = lengths[codes]
        ids = flat[ranges(starts[codes], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        counts = np.diff(ends)
        if whole.any():
            rows = np.flatnonzero(whole)
            own = {int(r): np.frombuffer(self._tokenize([texts[int(r)].as_py()])[0], np.uint32) for r in rows}
            ids = np.concatenate([own.get(r, ids[ends[r] : ends[r + 1]]) for r in range(len(texts))])
            counts[rows] = [len(own[int(r)]) for r in rows]
        return ids, counts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, counts = self.encode_column(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []

    def pieces(self) -> list[str]:
        """The vocabulary's strings by id, as the file has them."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        names = [""] * (max(vocabulary.values()) + 1)
        for name, number in vocabulary.items():
            names[number] = name
        return names


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool) -> Encoder:
    """The encoder of this worker for a vocabulary file."""
    key = (path, keeps_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, keeps_space)
    return _ENCODERS[key]


def groups(column: pa.Array, size: int = 8 << 20):
    """Runs (begin, end) of the texts of a column of about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64))
    begin = 0
    while begin < len(ends):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, "right")))
        yield begin, end
        begin = end
