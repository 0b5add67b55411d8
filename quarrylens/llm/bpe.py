"""BPE encoding and decoding with batched numpy merge rounds.

Symbols of many words lie in one flat array. Each round finds the pairs' ranks
by binary search over sorted pair keys, takes each word's lowest-ranked pair
and merges all its places at once, from the left; words without a pair left
are taken out. Only pairs beside a merge are looked up again.

Null texts are empty texts: no ids, empty decoded text. Repeated rows are
encoded alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, tokens

_NONE = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The vocabulary's letter for each byte: printable Latin-1 characters stand
    for themselves, all other bytes for code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab: dict[str, int] = data["model"]["vocab"]
        letters = byte_letters()
        self.size = max([*vocab.values(), *(x["id"] for x in data["added_tokens"])]) + 1
        text = [b""] * self.size
        for word, k in vocab.items():
            text[k] = bytes(letters[c] for c in word)
        for x in data["added_tokens"]:
            text[x["id"]] = x["content"].encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        self.token_size = np.array([len(x) for x in text], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.coder = tokens.WordCoder(self.encode_words, tokens.special_of(path))

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def encode_words(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, ws), np.int64, len(ws))
        sym = self.of_byte[np.frombuffer(b"".join(ws), np.uint8)]
        word = np.repeat(np.arange(len(ws)), sizes)
        out_sym, out_word = [], []
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], made[inner] = self._look(sym[inner], sym[inner + 1])
        while len(sym):
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(sym)))
            best = np.repeat(best, size)
            over = best == _NONE
            if over.any():
                out_sym.append(sym[over])
                out_word.append(word[over])
                go = ~over
                sym, word, rank, made, best = sym[go], word[go], rank[go], made[go], best[go]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            if len(at) > 1:  # of overlapping places every other one, from the left
                fresh = np.append(True, np.diff(at) != 1)
                run = np.flatnonzero(fresh)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))  # places after the right halves go
            sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
            touched = np.concatenate([moved, moved[moved > 0] - 1])
            rank[touched] = _NONE
            touched = touched[touched + 1 < len(sym)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched], made[touched] = self._look(sym[touched], sym[touched + 1])
        if not out_sym:
            return np.zeros(0, np.int32), sizes
        sym, word = np.concatenate(out_sym), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(ws))

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.coder.encode(raw, at)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.token_bytes[tokens.ranges(self.token_start[ids], self.token_size[ids])]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


_bpe: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """A process keeps one coder for each vocabulary file."""
    if path not in _bpe:
        _bpe[path] = Bpe(path)
    return _bpe[path]


def round_trip(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document's whole
    text; with ``keep_ids`` also ids (array of int) and the decoded text."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        coder = bpe(tokens.vocabulary_path(vocabulary))
        for b in batches:
            raw, at = common.raw_text(b.column("text"))
            for lo, hi, part, off in common.slices(raw, at):
                ids, cut = coder.encode(part, off)
                sizes = coder.token_size[ids]
                ends = np.append(0, np.cumsum(sizes))[cut]
                back = coder.decode_bytes(ids).tobytes()
                four = ids.astype("<u4").tobytes()
                told = [back[a:z].decode("utf-8", "replace") for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
                columns = [
                    b.column("doc_id").slice(lo, hi - lo),
                    pa.array(np.diff(cut)),
                    pa.array([hashlib.sha256(four[4 * a : 4 * z]).hexdigest() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in told], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32())), pa.array(told, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if keep_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
