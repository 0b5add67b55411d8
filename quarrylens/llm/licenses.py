"""License scans: an exact set-similarity join of text blocks with templates.

A text's blocks are its runs of consecutive words, up to half as many again as
the template has, wherever lines end: a notice wrapped over lines is found as on
one line, and words scattered over a long line are none. A block meets a template
if it holds at least four fifths of the template's distinct words. Template words
are ordered by their frequency over all documents, rarest first. Every block that
meets a template holds one of its prefix words, so only blocks around those are
looked at (prefix filter); the place of the rarest word held bounds the overlap
(positional filter); a stretch with too few words of the template is left out
(length filter); then blocks move over what is left, and those that meet the
template and touch make one span.

Null texts are empty: no words, no labels, score 0. Repeated rows are scanned
row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textbytes import LOWER, span_hash, spans

# Phrases of the contract with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Openings of public licences with their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "Copyright all rights reserved no part of this publication may be reproduced without permission"),
)
#: Least share, in fifths, of a template's words that a block must hold.
FIFTHS = 4
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def word_hashes(text: str) -> np.ndarray:
    low = LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end, _ = spans(_WORD[low], np.array([0, len(low)]))
    return span_hash(low, start, end)


class Templates:
    """Templates as sets of places in the vocabulary's global order."""

    def __init__(self, templates=TEMPLATES, counts: np.ndarray | None = None):
        sets = [np.unique(word_hashes(t)) for _, t in templates]
        self.vocabulary = np.unique(np.concatenate(sets))
        counts = np.zeros(len(self.vocabulary), np.int64) if counts is None else counts
        order = np.lexsort((self.vocabulary, counts))
        self.place = np.empty(len(order), np.int64)  # of each vocabulary word in the order
        self.place[order] = np.arange(len(order))
        self.labels = [x for x, _ in templates]
        self.sets = [np.sort(self.place[np.searchsorted(self.vocabulary, s)]) for s in sets]
        self.least = [-(-FIFTHS * len(s) // 5) for s in self.sets]
        self.reach = [-(-3 * len(word_hashes(t)) // 2) for _, t in templates]  # words in a block
        self.holds = np.zeros((len(templates), len(order)), bool)
        for t, x in enumerate(self.sets):
            self.holds[t, x] = True
        self.with_prefix: dict[int, list[int]] = {}
        self.is_prefix = np.zeros(len(order), bool)
        for t, (s, a) in enumerate(zip(self.sets, self.least)):
            for x in s[: len(s) - a + 1].tolist():
                self.with_prefix.setdefault(x, []).append(t)
                self.is_prefix[x] = True

    def known(self, h: np.ndarray) -> np.ndarray:
        """Places of words; -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, self.place[at], -1)

    def spans(self, place: np.ndarray, t: int, around: list[int]) -> list[tuple[int, int, float]]:
        """Spans of blocks that meet a template, in a text's words: first, end, and
        the largest share held. ``around``: where its prefix words stand."""
        least, reach, out = self.least[t], self.reach[t], []
        hi = -1
        stretches = []
        for q in around:
            if not stretches or q - reach + 1 > hi:
                stretches.append([max(0, q - reach + 1), q + reach])
            else:
                stretches[-1][1] = q + reach
            hi = q + reach
        for lo, hi in stretches:
            part = place[lo:hi]
            at = np.flatnonzero(part >= 0)
            at = at[self.holds[t, part[at]]]
            if len(at) < least:
                continue
            words, where = part[at].tolist(), (at + lo).tolist()
            held: dict[int, int] = {}
            j = 0
            for i, begin in enumerate(where):
                while j < len(where) and where[j] < begin + reach:
                    held[words[j]] = held.get(words[j], 0) + 1
                    j += 1
                # the rarest word held bounds what can be held: those after it in the order
                if len(held) >= least and len(self.sets[t]) - np.searchsorted(self.sets[t], min(held)) >= least:
                    share, end = len(held) / len(self.sets[t]), where[j - 1] + 1
                    if out and begin < out[-1][1]:
                        out[-1] = (out[-1][0], end, max(out[-1][2], share))
                    else:
                        out.append((begin, end, share))
                held[words[i]] -= 1
                if not held[words[i]]:
                    del held[words[i]]
        return out


def count_words(docs: DataFrame, templates=TEMPLATES) -> np.ndarray:
    """How often each template word stands in all documents."""
    common.small_batches(docs.sparkSession)
    bare = Templates(templates)
    held = docs.sparkSession.sparkContext.broadcast(bare.vocabulary)

    def run(batches):
        vocabulary = held.value
        total = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            raw, at = common.raw_text(b.column("text"))
            for _, _, part, off in common.slices(raw, at):
                low = LOWER[part]
                start, end, _ = spans(_WORD[low], off)
                h = span_hash(low, start, end)
                k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                total += np.bincount(k[vocabulary[k] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(total)), pa.int32()), "n": pa.array(total)})

    out = np.zeros(len(bare.vocabulary), np.int64)
    for r in docs.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, and spans: the blocks found (label, first word, end, share held)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(Templates(templates, count_words(docs, templates)))
    sought = [(word_hashes(p), label) for p, label in phrases]

    def run(batches):
        known = held.value
        for b in batches:
            raw, at = common.raw_text(b.column("text"))
            for lo, hi, part, off in common.slices(raw, at):
                n = hi - lo
                low = LOWER[part]
                start, end, row = spans(_WORD[low], off)
                h = span_hash(low, start, end)
                word0 = np.searchsorted(row, np.arange(n))
                labels = [set() for _ in range(n)]
                n_base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
                for p, label in sought:
                    k = len(p)
                    if len(h) < k:
                        continue
                    hit = row[: len(h) - k + 1] == row[k - 1 :]
                    for j in range(k):
                        hit &= h[j : len(h) - k + 1 + j] == p[j]
                    for w in np.flatnonzero(hit).tolist():
                        r = int(row[w])
                        w -= int(word0[r])
                        labels[r].add(label)
                        n_base[r] += 1
                        first[r] = w if first[r] < 0 else min(first[r], w)
                        last[r] = max(last[r], w)
                base = [",".join(sorted(x)) for x in labels]
                score = (n_base > 0).astype(float)
                found: list[list[dict]] = [[] for _ in range(n)]
                place = known.known(h)
                rare = np.flatnonzero((place >= 0) & known.is_prefix[np.maximum(place, 0)])
                ends = np.append(word0[1:], len(h))
                around: dict[tuple[int, int], list[int]] = {}
                for q in rare.tolist():
                    r = int(row[q])
                    for t in known.with_prefix[int(place[q])]:
                        around.setdefault((r, t), []).append(q - int(word0[r]))
                for (r, t), at_words in around.items():
                    for first_word, end_word, share in known.spans(place[word0[r] : ends[r]], t, at_words):
                        labels[r].add(known.labels[t])
                        score[r] = max(score[r], share)
                        found[r].append({"label": known.labels[t], "first": first_word, "end": end_word, "share": share})
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(lo, n), pa.array(np.bincount(row, minlength=n), pa.int64()), pa.array(n_base), pa.array(first, mask=first < 0), pa.array(last, mask=last < 0),
                        pa.array(base, pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score, pa.float64()),
                        pa.array(found, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label: string, first: long, end: long, share: double>>",
    )


#: What of it SQL expresses, in DuckDB: all but the method's own labels and score.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT unnest([{'p': ['under', 'the', 'mit', 'license'], 'l': 'mit'}, {'p': ['apache', 'license', 'version', '2'], 'l': 'apache-2'}, {'p': ['cc', 'by', 'nc'], 'l': 'cc-by-nc'}]) AS p),
h AS (SELECT doc_id, i - 1 AS i, p.p.l AS label FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d) x JOIN p ON x.w[i] = p.p.p[1] AND x.w[i:i + len(p.p.p) - 1] = p.p.p),
g AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
"""
