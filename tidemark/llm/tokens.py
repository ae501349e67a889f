"""Tokenizers with the units of text encoded once per task.

Both vocabularies cut a text into words before they merge, so a text's ids are its units' ids in a row. Each task
encodes a distinct unit once with the tokenizers library and keeps its ids; texts are then put together by numpy.
"""

from __future__ import annotations

import os
import string
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import trim

#: A task forgets the units that it has encoded beyond this number, so that its memory is bounded.
MAX_UNITS = 500_000
#: Bytes of text that are encoded at once: the more, the fewer lookups of distinct units.
TOKEN_BYTES = 3_000_000
#: A character between units that are encoded together; units that hold it are encoded one by one.
MARK = "\x01"
#: ASCII punctuation but the apostrophe.
TAIL = string.punctuation.replace("'", "")
_OPENED: dict[tuple[str, bool], "UnitEncoder"] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, keeps_space: bool) -> "UnitEncoder":
    """One encoder per Python worker."""
    if (path, keeps_space) not in _OPENED:
        _OPENED[path, keeps_space] = UnitEncoder(path, keeps_space)
    return _OPENED[path, keeps_space]


class UnitEncoder:
    """keeps_space: a word's ids depend on the space before it (byte-level BPE); else white space only parts words."""

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True  # what looks like a special token in a text is text
        self.between = f" {MARK}" if keeps_space else f" {MARK} "  # stands alone, as a word's white space goes with the word
        self.mark = self._plain_ids([self.between])[0]
        self.keeps_space = keeps_space
        self.clear()
        trim()  # reading the vocabulary takes several times its size

    def _plain_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        self.inside: dict[str, int] = {}
        self.leading: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.starts, self.lengths, self.hits = (np.zeros(1, np.int64) for _ in range(3))  # unit 0 is empty

    def forget(self) -> None:
        """Keeps the units that came back; if those are too many as well, none."""
        self.hits[0] = 3
        kept = np.flatnonzero(self.hits >= 3)
        if len(kept) > MAX_UNITS // 2:
            return self.clear()
        number = np.full(len(self.hits), -1, np.int64)
        number[kept] = np.arange(len(kept))
        self.inside, self.leading, self.tails = ({w: n for w, k in d.items() if (n := int(number[k])) >= 0} for d in (self.inside, self.leading, self.tails))
        self.pool, self.lengths = self._gather(kept), self.lengths[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.hits = np.zeros(len(kept), np.int64)

    def _gather(self, units: np.ndarray) -> np.ndarray:
        n = self.lengths[units]
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.starts[units] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (uint32), and where each text starts (one more for the end). Null: empty."""
        if len(column) == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self.starts) > MAX_UNITS:
            self.forget()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        parts = pc.split_pattern(pc.replace_substring(column, "\n", " \n" if self.keeps_space else " "), " ")
        bounds = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts = bounds[:-1]
        odd_docs: list[int] = []
        if self.keeps_space:
            odd = pc.match_substring_regex(coded.dictionary, _MAYBE_ODD).to_numpy(zero_copy_only=False).copy()
            for k in np.flatnonzero(odd).tolist():
                odd[k] = not _stands_after_space(words[k])
            at = np.flatnonzero(odd[codes])
            at = at[~np.isin(at, firsts)]
            odd_docs = sorted(set((np.searchsorted(bounds, at, "right") - 1).tolist()))
            units = self._ids_of(words, self.inside, lambda w: w if w[:1] == "\n" else " " + w, skip=odd)
            first, place = np.unique(codes[firsts], return_inverse=True)
            at_unit = units[codes]
            at_unit[firsts] = self._ids_of([words[c] for c in first.tolist()], self.leading, None)[place]
        else:
            at_unit = self._ids_of(words, self.inside, lambda w: w)[codes]
        flat = self._gather(at_unit)
        at = np.concatenate(([0], np.cumsum(self.lengths[at_unit])))[bounds]
        if not odd_docs:
            return flat, at
        docs = np.split(flat, at[1:-1])
        for k in odd_docs:
            docs[k] = np.asarray(self.plain.encode(column[k].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)

    def _ids_of(self, words: list[str], known: dict[str, int], unit, skip=None) -> np.ndarray:
        """The numbers of the words' units (unit: their texts; None: the words alone); units not met before are encoded."""
        units = np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))
        new = units == 0
        if skip is not None:
            new &= ~skip
        if new.any():
            places = np.flatnonzero(new)
            added = [words[p] for p in places.tolist()]
            units[places] = self._whole(added, unit) if unit is None else self._in_parts(added, known, unit)
            known.update(zip(added, units[places].tolist(), strict=True))
        self.hits[units] += 1
        return units

    def _in_parts(self, words: list[str], known: dict[str, int], unit) -> np.ndarray:
        """A word is a stem and the punctuation behind it, as both vocabularies cut between a letter or digit and a
        punctuation mark (TAIL leaves the apostrophe out); the uncased one has a word's ids for its lower case, too."""
        column = pa.array(words, pa.large_string())
        stems = pc.utf8_rtrim(column, characters=TAIL)
        cut = pc.and_(pc.not_equal(stems, column), pc.match_substring_regex(stems, r"[\p{L}\p{N}]$")).to_numpy(zero_copy_only=False)
        bases = [x if c else w for w, x, c in zip(words, stems.to_numpy(zero_copy_only=False).tolist(), cut.tolist(), strict=True)]
        if not self.keeps_space:
            bases = [w.lower() if w.isascii() else w for w in bases]
        distinct = dict.fromkeys(bases)
        base = np.fromiter(map(known.get, distinct, repeat(0)), np.int64, len(distinct))
        new = [w for w, k in zip(distinct, base.tolist(), strict=True) if not k]
        base[base == 0] = self._whole(new, unit)
        distinct = dict(zip(distinct, base.tolist(), strict=True))
        known.update(distinct)
        units = np.fromiter(map(distinct.__getitem__, bases), np.int64, len(bases))
        if cut.any():
            at = np.flatnonzero(cut)
            tails = [words[k][len(bases[k]) :] for k in at.tolist()]
            self._ids_of(list(dict.fromkeys(tails)), self.tails, None)
            both = np.stack((units[at], np.fromiter(map(self.tails.__getitem__, tails), np.int64, len(tails))), 1)
            units[at] = self._keep(self._gather(both.ravel()), self.lengths[both].sum(1))
        return units

    def _whole(self, words: list[str], unit) -> np.ndarray:
        """Encodes and keeps words; returns their numbers."""
        done = [self._encoded(words[k : k + 20_000], unit) for k in range(0, len(words), 20_000)]
        if not done:
            return np.zeros(0, np.int64)
        return self._keep(np.concatenate([ids for ids, _ in done]), np.concatenate([n for _, n in done]))

    def _encoded(self, words: list[str], unit) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row and how many each has. A word that holds MARK, and a leading word, is encoded alone."""
        if unit is not None:
            texts = list(map(unit, words))
            joined = self.between.join(texts)
            if joined.count(MARK) == len(words) - 1:
                ids = np.asarray(self._plain_ids([joined])[0], np.uint32)
                ends = np.append(np.flatnonzero(ids == self.mark[-1]) + 1, len(ids) + len(self.mark))
                kept = np.ones(len(ids), bool)
                for k in range(len(self.mark)):
                    kept[ends[:-1] - 1 - k] = False
                return ids[kept], np.diff(ends, prepend=0) - len(self.mark)
        else:
            texts = words
        alone = self._plain_ids(texts)
        return np.fromiter((i for ids in alone for i in ids), np.uint32), np.fromiter(map(len, alone), np.int64, len(alone))

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Adds units; returns their numbers."""
        first = len(self.starts)
        self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.hits = np.concatenate((self.hits, np.zeros(len(lengths), np.int64)))
        self.pool = np.concatenate((self.pool, ids))
        return np.arange(first, first + len(lengths))


#: What _stands_after_space may deny: it looks at these only.
_MAYBE_ODD = r"^\n?([^!-~]|$)"


def _stands_after_space(part: str) -> bool:
    """Whether the white space before this part always starts a token of its own word, so that texts may be cut there."""
    if part[:1] == "\n":
        part = part[1:]
    return bool(part) and not part[0].isspace()
