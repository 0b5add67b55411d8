"""Quality rules: countable rules, then a calibrated n-gram logistic regression.

Null texts count as texts without words. A text without words fails the base
rules (it has under ten words). Repeated rows are judged alike, row by row; an
empty table gives an empty result. Columns other than the id and the text are
never read, so that clashing names do no harm: outputs are made from the id,
the text and new columns only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ngrams
from .textbytes import IS_SPACE, mix, row_sums, span_hash, spans, windows

MIN_WORDS = 10
#: A text is kept if its calibrated probability of label 1 is this at least.
KEEP_AT = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(raw: np.ndarray, at: np.ndarray):
    """The base counts of each row, and the words' hashes and rows."""
    n = len(at) - 1
    inside = ~IS_SPACE[raw]
    start, end, row = spans(inside, at)
    h = span_hash(raw, start, end)
    n_words = np.bincount(row, minlength=n)
    word_chars = row_sums(inside & ((raw & 0xC0) != 0x80), at)
    n_symbols = row_sums(_SYMBOL[raw], at)
    l0, l1, lrow = spans(raw != 10, at)
    full = np.searchsorted(start, l1) > np.searchsorted(start, l0)
    l0, l1, lrow = l0[full], l1[full], lrow[full]
    line = span_hash(raw, l0, l1) ^ mix(lrow.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(line, return_index=True)
    n_dup = np.bincount(lrow, minlength=n) - np.bincount(lrow[first], minlength=n)
    at_word, win = windows(h, row, 5)
    again = np.zeros(len(h) + 4, bool)
    if len(win):
        _, which, times = np.unique(win ^ mix(row[at_word].astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
        for k in range(5):
            again[at_word[times[which] > 1] + k] = True
    n_repeat = np.bincount(row, again[: len(h)], n).astype(np.int64)
    return (n_words, word_chars, n_symbols, n_dup, n_repeat), (h, row)


def train(docs: DataFrame, labels: DataFrame, per_class: int = ngrams.SAMPLE_PER_CLASS) -> tuple[np.ndarray, float]:
    """Fit on at most ``per_class`` labelled rows of each class (those whose
    hashed id comes first), calibrate on a fifth of them held back, weighted to
    the classes' shares among all labels. Returns weights and intercept whose
    score is the log odds. Without labels of both classes every score is 0.5."""
    named = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("long").alias("cls"))
    total = {r["cls"]: r["n"] for r in named.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id"), F.col("doc_id")
    one, zero = (named.where(F.col("cls") == k).dropDuplicates(["doc_id"]).orderBy(*order).limit(per_class) for k in (1, 0))
    sample = ngrams.collect_sample(docs, one.unionByName(zero))
    size = ngrams.FAMILIES * ngrams.SIZE
    if len(set(sample.cls)) < 2:
        return np.zeros(size), 0.0
    y, held = sample.cls == 1, sample.part == 4
    weight = np.where(held, 0.0, np.where(y, 0.5 / max((y & ~held).sum(), 1), 0.5 / max((~y & ~held).sum(), 1)))

    def gradient(w, b):
        r = weight * (ngrams.sigmoid(sample.dot(w) + b) - y)
        return sample.back(r) + 1e-7 * w, r.sum()

    w, b = ngrams.descend(gradient, size, 60, 0.5)
    yh = y[held]
    if not yh.any() or yh.all():
        return w, b
    share = {k: total[k] / max((yh == k).sum(), 1) for k in (0, 1)}
    ph = np.where(yh, share[1], share[0])
    slope, shift = ngrams.platt(sample.dot(w)[held] + b, yh, ph * len(yh) / ph.sum())
    return w * slope, b * slope + shift


def _judged(raw, at, weights, intercept, keep_at):
    base, words = counts(raw, at)
    failed = (base[0] < MIN_WORDS) | (100 * base[4] > 20 * base[0])
    p = ngrams.sigmoid(ngrams.raw_scores(raw, at, weights, intercept, words))
    return base, failed, ~failed & (p >= keep_at), p


def score(docs: DataFrame, model, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the probability."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast((model[0].astype(np.float32), float(model[1])))

    def run(batches):
        weights, intercept = held.value
        for b in batches:
            raw, at = common.raw_text(b.column("text"))
            for lo, hi, part, off in common.slices(raw, at):
                base, failed, kept, p = _judged(part, off, weights, intercept, keep_at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in base), pa.array(failed), pa.array(kept), pa.array(p, pa.float64())],
                    ["doc_id", *COUNTS, "base_failed", "kept", "quality_p"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, kept boolean, quality_p double")


def keep(docs: DataFrame, model, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    spark = docs.sparkSession
    common.small_batches(spark)
    held = spark.sparkContext.broadcast((model[0].astype(np.float32), float(model[1])))

    def run(batches):
        weights, intercept = held.value
        for b in batches:
            raw, at = common.raw_text(b.column("text"))
            kept = [_judged(part, off, weights, intercept, keep_at)[2] for _, _, part, off in common.slices(raw, at)]
            yield b.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


#: What of it SQL expresses, in DuckDB: the base counts and their verdict.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
a AS (SELECT doc_id, g FROM v GROUP BY 1, 2 HAVING count(*) > 1), p AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS i FROM v SEMI JOIN a USING (doc_id, g)),
q AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
  coalesce(q.n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(q.n, 0) > 20 * len(w) AS base_failed FROM d LEFT JOIN l USING (doc_id) LEFT JOIN q USING (doc_id)
"""
