"""Quality classifier: positive-unlabelled learning with a non-negative risk.

Trusted positives are training-fold rows labelled 1; the unlabelled set is a
sample of web text, whatever its labels. The class prior is estimated from
positives and unlabelled text alone: a first model tells trusted positives from
web text, all documents of the training fold are counted by its score, and the
prior is the least ratio of the web's share to the positives' share above a
score, where the bound on that ratio's error is least (the positives are others
than those the model has seen). The logistic loss's risk is
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; where the second part is
negative its gradient is reversed. Negative labels enter once, and only to set
the scale: the score is calibrated, with both classes at equal weight, on
training-fold labels held back from the fit. Rows of the held-out fold (crc32 of
the id as text divisible by five) are used for nothing.

A null text is an empty text and has the intercept's score. A null id is in no
fold (held_out is false) and is never learnt from. Rows that repeat an id count
once in what a model is fitted on. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ngrams

PREDICT_AT = 0.3
#: Bounds on the rows a model is fitted on.
POSITIVES, UNLABELLED, CALIBRATION = 1500, 3000, 600
#: Bins of a score in which all documents are counted.
BINS = 1000


def fold(column="doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def split(positives: int, calibration: int):
    """The class of a chosen positive: 1 for calibration, 2 trusted."""
    return F.when(F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(100)) < 100 * calibration // (positives + calibration), 1).otherwise(2)


def prior_of(unlabelled: np.ndarray, positives: np.ndarray, sure: float = 0.1) -> float:
    """Share of positives among the unlabelled, from both sets' counts in bins of
    a score, ascending: the share of each above every bin is compared, at the bin
    where the ratio and its error bound (with probability 1 - ``sure``) are least."""
    n, m = unlabelled.sum(), positives.sum()
    if not n or not m:
        return 0.5
    u, p = np.cumsum(unlabelled[::-1]) / n, np.cumsum(positives[::-1]) / m
    off = np.sqrt(np.log(4 / sure) / (2 * n)) + np.sqrt(np.log(4 / sure) / (2 * m))
    some = p > 0
    k = np.argmin((u[some] + 1.01 * off) / p[some])
    return float(np.clip(u[some][k] / p[some][k], 0.01, 0.99))


def _counted(docs: DataFrame, weights: np.ndarray, intercept: float) -> np.ndarray:
    """All documents of the training fold, counted in bins of a model's score."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((weights.astype(np.float32), float(intercept)))

    def run(batches):
        total = np.zeros(BINS, np.int64)
        for b in batches:
            raw, at = common.raw_text(b.column("text"))
            for _, _, part, off in common.slices(raw, at):
                total += np.bincount(_bins(_probability(part, off, *held.value)), minlength=BINS)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(BINS), pa.int32()), "n": pa.array(total)})

    out = np.zeros(BINS, np.int64)
    web = docs.where(F.col("doc_id").isNotNull() & (fold() != 0)).select("text")
    for r in web.mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # one row a bin
        out[r["k"]] = r["n"]
    return out


def _bins(p: np.ndarray) -> np.ndarray:
    return np.minimum((p * BINS).astype(np.int64), BINS - 1)


def risk_gradient(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the risk by the scores of positives and of unlabelled rows,
    from their probabilities, and its second part; where that is negative, its
    gradient is reversed and the first part's left out."""
    low = lambda x: -np.log1p(-np.minimum(x, 1 - 1e-12))
    second = low(u).mean() - prior * low(p).mean()
    gp, gu, back = prior * (p - 1) / len(p), u / len(u), -prior * p / len(p)
    return (gp + back, gu, second) if second >= 0 else (-back, -gu, second)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, calibration: int = CALIBRATION) -> tuple[np.ndarray, float]:
    """Weights and intercept of calibrated log odds."""
    size = ngrams.FAMILIES * ngrams.SIZE
    named = labels.where(F.col("quality").isin(0, 1) & (fold() != 0)).select("doc_id", F.col("quality").alias("q")).dropDuplicates(["doc_id"])
    total = {r["q"]: r["n"] for r in named.groupBy("q").agg(F.count("*").alias("n")).collect()}
    if set(total) != {0, 1}:
        return np.zeros(size), 0.0
    order = F.xxhash64("doc_id", F.lit(11)), F.col("doc_id")
    ids = lambda q, n, cls: named.where(F.col("q") == q).orderBy(*order).limit(n).select("doc_id", F.lit(cls).cast("long").alias("cls"))
    # classes: 0 and 1 for calibration, 2 trusted positives, 3 unlabelled
    ones = ids(1, positives + calibration, 2)
    web = docs.where(F.col("doc_id").isNotNull() & (fold() != 0)).select("doc_id").distinct()
    web = web.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(unlabelled).select("doc_id", F.lit(3).cast("long").alias("cls"))
    chosen = ones.select("doc_id", split(positives, calibration).cast("long").alias("cls")).unionByName(ids(0, calibration, 0)).unionByName(web)
    s = ngrams.collect_sample(docs, chosen)
    pos, unl, cal = s.cls == 2, s.cls == 3, s.cls < 2
    if not pos.any() or not unl.any():
        return np.zeros(size), 0.0

    def first(w, b):  # trusted positives from web text, at equal weight
        score = ngrams.sigmoid(s.dot(w) + b)
        g = np.zeros(len(s))
        g[pos], g[unl] = 0.5 * (score[pos] - 1) / pos.sum(), 0.5 * score[unl] / unl.sum()
        return s.back(g) + 1e-6 * w, g.sum()

    w, b = ngrams.descend(first, size, 40, 0.5)
    other = ngrams.sigmoid(s.dot(w) + b)[s.cls == 1]
    prior = prior_of(_counted(docs, w, b), np.bincount(_bins(other), minlength=BINS)) if len(other) else 0.5

    def gradient(w, b):
        score = ngrams.sigmoid(s.dot(w) + b)
        g = np.zeros(len(s))
        g[pos], g[unl], _ = risk_gradient(score[pos], score[unl], prior)
        return s.back(g) + 1e-7 * w, g.sum()

    w, b = ngrams.descend(gradient, size, 80, 0.5)
    y = s.cls[cal] == 1
    if not y.any() or y.all():
        return w, b
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    slope, shift = ngrams.platt(s.dot(w)[cal] + b, y, weight * len(y))
    return w * slope, b * slope + shift


def _probability(raw, at, weights, intercept):
    return ngrams.sigmoid(ngrams.raw_scores(raw, at, weights, intercept))


def score(docs: DataFrame, model, at_least: float = PREDICT_AT) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast((model[0].astype(np.float32), float(model[1])))

    def run(batches):
        weights, intercept = held.value
        for b in batches:
            raw, at = common.raw_text(b.column("text"))
            for lo, hi, part, off in common.slices(raw, at):
                p = _probability(part, off, weights, intercept)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("held_out").slice(lo, hi - lo), pa.array(p, pa.float64()), pa.array((p >= at_least).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def keep(docs: DataFrame, model, at_least: float = PREDICT_AT) -> DataFrame:
    """The rows whose score reaches ``at_least``, with all their columns."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast((model[0].astype(np.float32), float(model[1])))

    def run(batches):
        weights, intercept = held.value
        for b in batches:
            raw, at = common.raw_text(b.column("text"))
            kept = [_probability(part, off, weights, intercept) >= at_least for _, _, part, off in common.slices(raw, at)]
            yield b.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
