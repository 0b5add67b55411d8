"""Token ids of many texts: each distinct word is encoded once and kept.

``WordCoder`` cuts slices of texts into words, asks ``encode_words`` for the
ids of words not met before, and strings the ids of all words together. What
it keeps is bounded; beyond the bound it starts anew.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np

from .pretok import words

#: Words and ids that a worker keeps at most.
KEEP_WORDS, KEEP_IDS = 700_000, 6_000_000
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[0].., start[1].. of ``size`` each, end to end."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(total)


class WordCoder:
    """Ids of words, kept in a hash table of two probes; a word that finds no
    free place is simply encoded again when it is met again."""

    SLOTS = 1 << 20

    def __init__(self, encode_words: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], special: tuple[bytes, int] | None):
        """encode_words: from words to their ids end to end and the number of each."""
        self.encode_words, self.special = encode_words, special
        self._anew()

    def _anew(self) -> None:
        self.key, self.entry = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.flat, self.n_flat = np.zeros(1 << 16, np.int32), 0
        self.start, self.size, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _probes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(self.SLOTS - 1)
        return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        one, two = self._probes(h)
        out = np.where(self.key[one] == h, self.entry[one], -1)
        rest = np.flatnonzero(out < 0)
        two = two[rest]
        out[rest] = np.where(self.key[two] == h[rest], self.entry[two], -1)
        return out

    def _add(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        k, m = len(h), len(ids)
        while self.n + k > len(self.start):
            self.start, self.size = np.concatenate([self.start] * 2), np.concatenate([self.size] * 2)
        while self.n_flat + m > len(self.flat):
            self.flat = np.concatenate([self.flat] * 2)
        self.flat[self.n_flat : self.n_flat + m] = ids
        self.start[self.n : self.n + k] = self.n_flat + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + k] = sizes
        left = np.arange(k)
        for slot in self._probes(h):
            slot = slot[left]
            free = self.key[slot] == 0
            slot, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.key[slot], self.entry[slot] = h[put], self.n + put
            stay = np.ones(k, bool)
            stay[put] = False
            left = left[stay[left]]
        self.n, self.n_flat = self.n + k, self.n_flat + m

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a slice, end to end, and the rows' offsets in them."""
        s, e, h, row, is_special = words(raw, at, self.special and self.special[0])
        n = len(at) - 1
        if not len(s):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        if self.n > KEEP_WORDS or self.n_flat > KEEP_IDS:
            self._anew()
        h |= np.uint64(1)  # 0 marks a free place
        entry = self._find(h)
        new = np.flatnonzero((entry < 0) & ~is_special)
        if len(new):
            uniq, first, which = np.unique(h[new], return_index=True, return_inverse=True)
            blob, f = raw.tobytes(), new[first]
            ids, sizes = self.encode_words([blob[a:b] for a, b in zip(s[f].tolist(), e[f].tolist())])
            entry[new] = self.n + which
            self._add(uniq, ids, sizes)
        if is_special.any():
            entry[is_special] = self.n
            self._add(h[is_special][:1], np.array([self.special[1]], np.int32), np.array([1]))
        size = self.size[entry]
        ids = self.flat[ranges(self.start[entry], size)]
        return ids, np.append(0, np.cumsum(np.bincount(row, size, n).astype(np.int64)))


def special_of(path: str) -> tuple[bytes, int] | None:
    with open(path) as f:
        added = json.load(f)["added_tokens"]
    if len(added) > 1:
        raise ValueError("vocabularies with one special token only")
    return (added[0]["content"].encode(), added[0]["id"]) if added else None


_library: dict[str, WordCoder] = {}


def library_coder(name: str = VOCABULARY) -> WordCoder:
    """A coder whose words the tokenizers library encodes (kept by process)."""
    if name not in _library:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary_path(name)
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()

        special = special_of(path)
        if special is None:
            raise ValueError("a vocabulary with a special token")
        between = special[0].decode()  # no word holds it, so its id parts the words

        def encode_words(ws: list[bytes]):
            line = [between] * (2 * len(ws))
            line[::2] = [w.decode() for w in ws]
            ids = np.array(tok.encode_batch_fast([line], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
            end = np.flatnonzero(ids == special[1])
            return ids[ids != special[1]], np.diff(end, prepend=-1) - 1

        _library[name] = WordCoder(encode_words, special)
    return _library[name]
