"""Hashed word and character n-grams, and linear models over their frequencies.

A text's features are the relative frequencies, in fixed hash tables, of its
words, its word pairs (pairs of one word share an entry) and its byte trigrams; a model's score is an
intercept plus the mean weight of the text's n-grams in each family.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textbytes import IS_SPACE, span_hash, spans, windows

BITS = 16
SIZE = 1 << BITS
FAMILIES = 3
#: Labelled rows of each class used to fit a model.
SAMPLE_PER_CLASS = 1500
_SHIFT = np.uint64(64 - BITS)


def families(raw: np.ndarray, at: np.ndarray, words=None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(table index, row) of every n-gram, family by family."""
    if words is None:
        start, end, row = spans(~IS_SPACE[raw], at)
        h = span_hash(raw, start, end)
    else:
        h, row = words
    out = [((h >> _SHIFT).astype(np.int64), row)]
    first, pair = windows(h, row, 2)
    index = (pair >> _SHIFT).astype(np.int64)
    index[h[first] == h[first + 1]] = 0  # a word said twice running, whatever the word
    out.append((index + SIZE, row[first]))
    if len(raw) >= 3:
        code = raw[:-2].astype(np.uint32) | (raw[1:-1].astype(np.uint32) << 8) | (raw[2:].astype(np.uint32) << 16)
        code *= np.uint32(0x9E3779B1)
        inside = np.ones(len(raw), bool)
        edges = at[1:-1]
        inside[np.maximum(edges - 1, 0)] = False
        inside[np.maximum(edges - 2, 0)] = False
        index = (code >> np.uint32(32 - BITS)).astype(np.int64) + 2 * SIZE
        sizes = np.diff(at)
        rows = np.repeat(np.arange(len(sizes)), sizes)[:-2]
        keep = inside[:-2]
        if not keep.all():
            index, rows = index[keep], rows[keep]
        out.append((index, rows))
    else:
        out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return out


def raw_scores(raw: np.ndarray, at: np.ndarray, weights: np.ndarray, intercept: float, words=None) -> np.ndarray:
    """Linear scores of rows; an empty text has the intercept."""
    n = len(at) - 1
    total = np.full(n, intercept)
    for index, row in families(raw, at, words):
        if len(index):
            sums = np.bincount(row, weights[index], n)
            total += sums / np.maximum(np.bincount(row, minlength=n), 1)
    return total


def vector(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One text's sparse features: table indices and relative frequencies."""
    at = np.array([0, len(raw)])
    idx, val = [], []
    for index, _ in families(raw, at):
        if len(index):
            u, c = np.unique(index, return_counts=True)
            idx.append(u)
            val.append(c / len(index))
    if not idx:
        return np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(idx), np.concatenate(val)


def _featurise(batches):
    for b in batches:
        raw, at = common.raw_text(b.column("text"))
        idx, val = [], []
        for i in range(len(at) - 1):
            x, v = vector(raw[at[i] : at[i + 1]])
            idx.append(x.astype(np.int32).tobytes())
            val.append(v.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("cls"), b.column("part"), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["doc_id", "cls", "part", "idx", "val"])


class Sample:
    """Rows of features end to end, with their class and one of five parts; what
    is worked out over them takes memory for ``CHUNK`` features only."""

    CHUNK = 1 << 19

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.cls, self.part = table.column("cls").to_numpy(), table.column("part").to_numpy()
        idx, val = (table.column(c).chunk(0) if len(table) else pa.array([], pa.binary()) for c in ("idx", "val"))
        offsets = np.frombuffer(idx.buffers()[1], np.int32)[: len(idx) + 1].astype(np.int64) if len(idx) else np.zeros(1, np.int64)
        self.at = (offsets - offsets[0]) // 4
        self.idx = np.frombuffer(idx.buffers()[2], np.int32, self.at[-1]) if self.at[-1] else np.zeros(0, np.int32)
        self.val = np.frombuffer(val.buffers()[2], np.float32, self.at[-1]) if self.at[-1] else np.zeros(0, np.float32)

    def __len__(self) -> int:
        return len(self.cls)

    def _chunks(self):
        for lo, hi, _, _ in common.slices(self.idx, self.at, self.CHUNK):
            a, z = self.at[lo], self.at[hi]
            yield lo, hi, self.idx[a:z], self.val[a:z], np.repeat(np.arange(hi - lo), np.diff(self.at[lo : hi + 1]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Score of each row."""
        out = np.zeros(len(self))
        for lo, hi, idx, val, row in self._chunks():
            out[lo:hi] = np.bincount(row, w[idx] * val, hi - lo)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        """Gradient of the weights from one value a row."""
        out = np.zeros(FAMILIES * SIZE)
        for lo, hi, idx, val, row in self._chunks():
            out += np.bincount(idx, g[lo:hi][row] * val, len(out))
        return out


def collect_sample(docs: DataFrame, chosen: DataFrame) -> Sample:
    """Features of the documents in ``chosen`` (doc_id, cls), which the caller
    has bounded to a documented number of rows; only such ids are broadcast. Of
    rows that repeat an id one counts, so the sample is bounded too."""
    common.small_batches(docs.sparkSession)
    part = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(5)).cast("long").alias("part")
    picked = docs.select("doc_id", common.text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "cls", part, "text")
    found = picked.mapInArrow(_featurise, "doc_id long, cls long, part long, idx binary, val binary")
    one = found.groupBy("doc_id", "cls").agg(F.min(F.struct("part", "idx", "val")).alias("x"))
    return Sample(one.select("cls", "x.*").orderBy("cls", "doc_id").toArrow())


def descend(gradient, size: int, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Adam from zero: ``gradient(w, b)`` gives both gradients."""
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = gradient(w, b)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= 0.1 * rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, b


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(score: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of class on score (Newton steps, with
    the usual smoothed targets)."""
    n1, n0 = positive.sum(), (~positive).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, spread = score.mean(), score.std() or 1.0
    x = (score - mean) / spread

    def loss(a, c):
        z = a * x + c
        return (weight * (np.logaddexp(0, z) - target * z)).sum() + 5e-4 * a * a

    a, c = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * x + c)
        r, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * x).sum() + 1e-3 * a, r.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step, now = np.linalg.solve(hess, g), loss(a, c)
        while np.abs(step).max() >= 1e-7 and loss(a - step[0], c - step[1]) > now:
            step = step / 2  # a whole step may overshoot where the classes lie far apart
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-7:
            break
    a = max(a, 1e-6)
    return a / spread, c - a * mean / spread
