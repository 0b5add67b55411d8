"""URL filters: rules, then host word segmentation and naive Bayes.

A host's labels are cut into words by a unigram Viterbi search over the
``VOCABULARY`` most frequent words of all pages' visible text and the seed
words. Words are counted exactly over all pages; among words of like frequency
(the same eighth-power of two) a hash decides which enter. Words of over
``LONGEST`` letters are in no vocabulary.

A multinomial naive Bayes model, fitted on every url that a rule judges, scores
the words of host and path for the urls that no rule fits: a url is blocked if
its probability of that class is ``BLOCK_AT`` at least, so that clean sites are
left alone where the evidence is thin.
The words of the rules themselves, of all of them, are no evidence: they stand
in one class because the rule says so, and tell nothing about other urls. Seed
words (a parameter) are host words known to mark unwanted sites, since rules
alone need not name any: each counts as ``SEED_SHARE`` of the block class's words.

A null url, or one without ``://``, has empty host and path, fits no rule and
is judged by the classes' priors alone. Hosts of any length are cut whole.
Repeated rows are judged row by row; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textbytes import LOWER, span_hash, spans

# The rules of the contract (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Host words of unwanted sites.
SEEDS = ("adult", "ads", "bet", "bets", "casino", "malware", "phishing", "pills", "poker", "porn", "slots", "spam", "track", "tracker", "viagra", "xxx")
#: Weight of a seed word; size of the unigram model, longest word in it, bits of
#: the token table's index.
SEED_SHARE, VOCABULARY, LONGEST, BITS = 0.01, 50_000, 20, 16
#: Least probability of the block class at which a url is blocked.
BLOCK_AT = 0.95
_ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_PIECES = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = re.search(r"[/?#]", rest)
    at = end.start() if end else len(rest)
    return rest[:at].translate(_ASCII_LOWER), re.split(r"[?#]", rest[at:], maxsplit=1)[0]


def rule_of(host: str, path: str, rules=RULES) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict."""
    best = None
    for h, p, verdict in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, verdict
    return best or (None, None)


def in_tags(low: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which bytes lie in a tag: from a ``<`` before a letter, ``/``, ``!`` or
    ``?`` to the next ``>`` of the row. A ``<`` that is never closed opens none."""
    n = len(low)
    if not n:
        return np.zeros(0, bool)
    follows = np.append(low[1:], 0)
    follows[at[1:][at[1:] > 0] - 1] = 0  # what follows a row's end is another row's
    place = np.arange(n)
    opens = (low == ord("<")) & (((follows >= 97) & (follows <= 122)) | np.isin(follows, [ord("/"), ord("!"), ord("?")]))
    closes = low == ord(">")
    sizes = np.diff(at)
    begin, end = np.repeat(at[:-1], sizes), np.repeat(at[1:], sizes)
    last = np.maximum.accumulate(np.where(opens, 2 * place + 1, np.where(closes, 2 * place, -1)))
    # the byte of a closing mark itself belongs to its tag
    last = np.where(closes, np.append(-1, last[:-1]), last)
    close = np.minimum.accumulate(np.where(closes, place, n)[::-1])[::-1]
    return (last >= 2 * begin) & (last % 2 == 1) & (close < end)


def count_words(pages: DataFrame, size: int = VOCABULARY, seeds=SEEDS) -> dict[str, int]:
    """The ``size`` most frequent words of visible text, counted over all pages,
    and the seeds. Frequency is told by eighth-powers of two, then by a hash."""
    common.small_batches(pages.sparkSession)

    def run(batches):
        held: dict[bytes, int] = {}

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array([k.decode("utf-8", "replace") for k in held], pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for b in batches:
            raw, at = common.raw_text(b.column("html"))
            for _, _, part, off in common.slices(raw, at):
                low = LOWER[part]
                start, end, _ = spans(_LETTER[low] & ~in_tags(low, off), off)
                fits = end - start <= LONGEST
                start, end = start[fits], end[fits]
                _, first, times = np.unique(span_hash(low, start, end), return_index=True, return_counts=True)
                blob = low.tobytes()
                for a, z, m in zip(start[first].tolist(), end[first].tolist(), times.tolist()):
                    held[blob[a:z]] = held.get(blob[a:z], 0) + m
                if len(held) > 200_000:
                    yield out()
                    held = {}
        yield out()

    words = pages.select("html").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with common.scratch(pages.sparkSession):
        words = common.written(words, "words").withColumns({"step": F.floor(8 * F.log2("n")).cast("int"), "h": F.xxhash64("word")})
        steps = {r["step"]: r["m"] for r in words.groupBy("step").agg(F.count("*").alias("m")).collect()}  # some hundred rows
        room, least = size, max(steps, default=0) + 1
        for step in sorted(steps, reverse=True):
            if steps[step] > room:
                break
            room, least = room - steps[step], step
        taken = words.where(F.col("step") >= least)
        if room and (edge := max((s for s in steps if s < least), default=None)) is not None:
            share = min(1.0, (1.2 * room + 1000) / steps[edge])  # a few more than there is room for, by hash
            near = words.where((F.col("step") == edge) & (F.col("h") <= F.lit(int(-(2**63) + share * (2**64 - 1025)))))
            taken = taken.unionByName(near.orderBy("h", "word").limit(room))
        out = {r["word"]: r["n"] for r in taken.collect()}  # at most ``size`` words
    usual = sorted(out.values())[len(out) // 2] if out else 1
    return {w: usual for w in seeds} | out


class Segmenter:
    """Splits a run of letters into the likeliest words."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.unknown = math.log(total)
        self.kept: dict[str, list[str]] = {}

    def split(self, run: str) -> list[str]:
        if run in self.kept:
            return self.kept[run]
        best, back = [0.0], [0]
        for i in range(1, len(run) + 1):
            options = []
            for j in range(max(0, i - LONGEST), i):
                known = self.cost.get(run[j:i])
                options.append((best[j] + (self.unknown + math.log(10) * (i - j) if known is None else known), -j))
            cost, j = min(options)
            best.append(cost)
            back.append(-j)
        out, i = [], len(run)
        while i:
            out.append(run[back[i] : i])
            i = back[i]
        if len(self.kept) > 100_000:
            self.kept.clear()
        self.kept[run] = out[::-1]
        return self.kept[run]

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host, marked as such, and of the path; digits as one token."""
        out = []
        for mark, text in (("h:", host), ("p:", path.translate(_ASCII_LOWER))):
            for piece in _PIECES.findall(text):
                out += [mark + "0"] if piece.isdigit() else [mark + w for w in self.split(piece)]
        return out


def buckets(tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the token table of many lists' tokens, end to end, and the list of each."""
    raw, at = common.raw_text(pa.array([t for x in tokens for t in x], pa.string()))
    return (span_hash(raw, at[:-1], at[1:]) >> np.uint64(64 - BITS)).astype(np.int64), np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])


def rule_words(segmenter: Segmenter, rules=RULES) -> frozenset[str]:
    """The tokens of all rules: what makes a rule fit is no evidence."""
    plain = {"h:" + w for h, _, _ in rules for w in h.split(".")} | {"p:" + w for _, p, _ in rules for w in p.strip("/").split("/") if w}
    return frozenset(plain.union(*(segmenter.tokens(h, p) for h, p, _ in rules)))


def odds(times: np.ndarray, urls: np.ndarray, seeds=SEEDS, seed_share: float = SEED_SHARE) -> tuple[np.ndarray, float]:
    """Log odds of block against allow of each token, and of the classes, from
    counts (allow, block) with one added to each."""
    times, urls = times + 1.0, urls + 1.0
    if seeds:
        times[1, buckets([["h:" + w for w in seeds]])[0]] += seed_share * times[1].sum()
    share = np.log(times / times.sum(1, keepdims=True))
    return share[1] - share[0], float(np.log(urls[1] / urls[0]))


def fit(pages: DataFrame, segmenter, rules=RULES, seeds=SEEDS, seed_share: float = SEED_SHARE) -> tuple[np.ndarray, float]:
    """The naive Bayes model (log odds of tokens, of classes), from every url
    that a rule judges; urls of one class with the same tokens count once, so
    that no site speaks for its class by its number of pages."""

    def lists(batches):
        seen: set[tuple[int, str]] = set()
        own = rule_words(segmenter.value, rules)
        for b in batches:
            fresh = set()
            for url in b.column("url").to_pylist():
                host, path = split_url(url)
                if verdict := rule_of(host, path, rules)[1]:
                    fresh.add((int(verdict == "block"), " ".join(t for t in segmenter.value.tokens(host, path) if t not in own)))
            fresh -= seen
            seen = fresh if len(seen) > 100_000 else seen | fresh
            yield pa.RecordBatch.from_pydict({"c": pa.array([c for c, _ in fresh], pa.int32()), "words": pa.array([w for _, w in fresh], pa.string())})

    def count(batches):
        times, urls = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for b in batches:
            c = b.column("c").to_numpy()
            k, row = buckets([x.split() for x in b.column("words").to_pylist()])
            np.add.at(times, (c[row], k), 1)
            urls += np.bincount(c, minlength=2)
        c, k = np.nonzero(times)
        yield pa.RecordBatch.from_pydict({"c": pa.array(np.append(c, [0, 1]), pa.int32()), "k": pa.array(np.append(k, [-1, -1]), pa.int32()), "n": pa.array(np.append(times[c, k], urls))})

    times, urls = np.zeros((2, 1 << BITS)), np.zeros(2)
    distinct = pages.select("url").mapInArrow(lists, "c int, words string").distinct()
    summed = distinct.mapInArrow(count, "c int, k int, n long").groupBy("c", "k").agg(F.sum("n").alias("n"))
    for c, k, n in zip(*(x.to_pylist() for x in summed.toArrow().columns)):  # at most two rows a bucket
        if k < 0:
            urls[c] += n
        else:
            times[c, k] += n
    return odds(times, urls, seeds, seed_share)


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS, seed_share: float = SEED_SHARE, block_at: float = BLOCK_AT) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block), words."""
    sc = pages.sparkSession.sparkContext
    bound = math.log(block_at / (1 - block_at))
    segmenter = sc.broadcast(Segmenter(count_words(pages, seeds=seeds)))
    model = sc.broadcast(fit(pages, segmenter, rules, seeds, seed_share))

    def run(batches):
        weights, prior = model.value
        own = rule_words(segmenter.value, rules)
        for b in batches:
            split = [split_url(url) for url in b.column("url").to_pylist()]
            ruled = [rule_of(host, path, rules) for host, path in split]
            tokens = [segmenter.value.tokens(host, path) for host, path in split]
            k, row = buckets([[t for t in x if t not in own] for x in tokens])
            score = prior + np.bincount(row, weights[k], len(split))
            verdict = [given or ("block" if s >= bound else "allow") for (_, given), s in zip(ruled, score.tolist())]
            columns = [h for h, _ in split], [p for _, p in split], [r for r, _ in ruled], verdict
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), *(pa.array(x, pa.string()) for x in columns), pa.array(score, pa.float64()), pa.array([" ".join(x) for x in tokens], pa.string())],
                ["page_id", "host", "path", "rule", "verdict", "score", "words"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double, words string")


#: What of it SQL expresses, in DuckDB: host, path, rule, and the rule's verdict.
SQL = r"""
WITH u AS (SELECT page_id, strpos(url, '://') AS k, url FROM pages), r AS (SELECT page_id, CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(rh, rp, verdict)),
m AS (SELECT page_id, arg_max({'r': rh || rp, 'v': verdict}, len(rh || rp)) AS x FROM l JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT l.page_id, host, path, x.r AS rule, x.v AS rule_verdict FROM l LEFT JOIN m USING (page_id)
"""
