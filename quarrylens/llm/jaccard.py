"""N-gram Jaccard join by multiple-global-order prefix filters.

A document's set holds the hashes of its distinct five-word shingles. Equal
sets are one node. Tokens stand in several global orders, each by frequency and
then by a hash of its own, so that common passages come last: very frequent
tokens by class (counts over all documents in a fixed number of hash buckets),
before them common tokens by level (each token's documents are counted, and the
levels kept in a hashed map of bounded size), and first of all the rest. What
the hashing joins changes an order only, not the result. Two sets that
link share a token within their prefixes under every order. The first order's
prefixes are indexed, but for tokens that no other document holds. A candidate
must then pass the length test (also on the tokens others hold), a count under
a second order (the longer prefixes kept as signatures must share as many
tokens as a link cannot do without) and the prefix test of a third; only what
passes all of them is verified on the whole sets.

A posting list first gives only its members' pairs with its hub: the member
most of whose tokens are common (of near copies, the text they were made from),
so that lists of like members have one hub. Tokens are counted, and copies of one
set dropped from the lists, within each task before they are sent; the list of a
token that very many sets hold is split by a hash of the set, and the hubs of its
parts are paired with the first of them. Once components are known from those, the
members outside a list's main component are compared with the members of other
components of like size, in blocks, so every link is either verified or implied,
and no list is expanded into its pairs.

Null and wordless texts have empty sets and stay alone. A null id is a document
like others and never the component's id unless alone. Repeated rows are equal
sets. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_unique
from . import common
from .components import components
from .textbytes import IS_SPACE, LOWER, mix, span_hash, spans, windows
from .tokens import ranges

WORDS = 5
#: Buckets of the frequency counts, entries of the index per group, and sets in a
#: part of a token's list (told by an upper bound on the sets that hold it).
COUNT_BITS, GROUP_ENTRIES, LIST_PART = 18, 400_000, 20_000
#: Entries that a task holds before it sends them on.
FLUSH_ENTRIES = 250_000
#: Least and greatest bits of the map of wanted documents; it has about eight for
#: each of them up to the greatest (8 MB).
WANTED_BITS, MOST_WANTED_BITS = 20, 26
#: Documents that hold a token from its first, second and third level on, and
#: the greatest number of entries of the map of levels, as a power of two.
LEVELS, MOST_LEVEL_BITS = (2, 25, 200), 27
#: Share of a set kept as its signature, in tenths, and the least tokens kept.
SIGNATURE_TENTHS, SIGNATURE_LEAST = 4, 16
#: Outsiders and members in a block of the second round.
OUTSIDERS, MEMBERS = 64, 256
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0))


def needed(n):
    """The least overlap with a set of n that a link can have: ceil(4 n / 5)."""
    return (4 * n + 4) // 5


def sets(raw: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each row's sorted distinct shingle hashes, and its node (0: empty)."""
    low = LOWER[raw]
    start, end, row = spans(~IS_SPACE[low], at)
    h = span_hash(low, start, end)
    first, win = windows(h, row, WORDS)
    n = len(at) - 1
    of = row[first]
    lo, hi = np.searchsorted(of, np.arange(n)), np.searchsorted(of, np.arange(n), "right")
    w0, w1 = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), "right")
    out, nodes = [], np.zeros(n, np.uint64)
    for k in range(n):
        if hi[k] > lo[k]:
            got = np.sort(win[lo[k] : hi[k]])
            if len(got) > 1:
                got = got[np.append(True, got[1:] != got[:-1])]
        elif w1[k] > w0[k]:
            code = np.uint64(w1[k] - w0[k])
            for x in h[w0[k] : w1[k]]:
                code = mix(np.array([code], np.uint64) * np.uint64(31) + x)[0]
            got = np.array([code], np.uint64)
        else:
            got = np.zeros(0, np.uint64)
        out.append(got)
        if len(got):
            nodes[k] = mix(np.array([mix(got ^ _SEEDS[2]).sum() + np.uint64(len(got))], np.uint64))[0] | np.uint64(1)
    return out, nodes


class Orders:
    """Places of tokens in the global orders. ``levels``: two bits an entry."""

    def __init__(self, classes: np.ndarray, levels: np.ndarray, mean: float = 1.0, list_part: int = LIST_PART):
        self.classes, self.levels, self.mean, self.list_part = classes, levels, mean, list_part
        self.shift = np.uint64(64 - int(4 * len(levels) - 1).bit_length())

    def level(self, tokens: np.ndarray) -> np.ndarray:
        at = (mix(tokens ^ _SEEDS[0]) >> self.shift).astype(np.int64)
        return (self.levels[at >> 2] >> ((at & 3) * 2).astype(np.uint8)) & np.uint8(3)

    def parts(self, tokens: np.ndarray) -> np.ndarray:
        """Into how many parts the lists of tokens are split: by the greatest
        count that a token's bucket may have, for tokens of the last level."""
        times = self.mean * 2.0 ** ((self.classes[(tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(float) + 1) / 2)
        return np.where(self.level(tokens) == len(LEVELS), np.ceil(times / self.list_part).clip(1, 65535), 1).astype(np.int64)

    def place(self, tokens: np.ndarray, j: int) -> np.ndarray:
        step = self.classes[(tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
        step = np.where(step > 0, step + np.uint64(3), self.level(tokens).astype(np.uint64))
        return (step << np.uint64(56)) | (mix(tokens ^ _SEEDS[j]) >> np.uint64(8))

    def shared(self, tokens: np.ndarray) -> int:
        """How many tokens of a set other documents may hold too. No link can rest
        on the others."""
        return int((self.level(tokens) > 0).sum())

    def prefix(self, tokens: np.ndarray, j: int) -> np.ndarray:
        p = len(tokens) - needed(len(tokens)) + 1
        if p >= len(tokens):
            return tokens
        return tokens[np.argpartition(self.place(tokens, j), p - 1)[:p]]


def signature(tokens: np.ndarray) -> np.ndarray:
    """The first tokens of a set in the second order, as sorted 32-bit places."""
    q = min(len(tokens), max(-(-SIGNATURE_TENTHS * len(tokens) // 10), SIGNATURE_LEAST))
    place = mix(tokens ^ _SEEDS[1])
    if q < len(place):
        place = np.partition(place, q - 1)[:q]
    return np.sort((place >> np.uint64(32)).astype("<u4"))


def may_link(x: np.ndarray, n: int, y: np.ndarray, m: int) -> bool:
    """Whether sets of n and m tokens with signatures x and y may link. The
    tokens that both share are in the prefix that ends first, or among the rest
    of its set; so many of them must stand in both signatures."""
    if x[-1] > y[-1]:
        x, n, y, m = y, m, x, n
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    shared = int((y[at] == x).sum())
    if x[-1] == y[-1]:  # 32 bits do not tell which of equal places comes first
        shared += int((x == x[-1]).sum())
    return 9 * (shared + n - len(x)) >= 4 * (n + m)


def packed(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of tokens, six bytes each."""
    return (tokens >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """Tokens as ``packed`` keeps them, the lower bits 0."""
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def links(x: np.ndarray, y: np.ndarray, orders: Orders) -> bool:
    """Whether two sets link: the third order's prefixes, then the overlap."""
    n, m = len(x), len(y)
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    if not np.isin(orders.prefix(x, 2), orders.prefix(y, 2)).any():
        return False
    both = n + m - len(np.unique(np.concatenate([x, y])))
    return 5 * both >= 4 * (n + m - both)


def _counted(docs: DataFrame) -> DataFrame:
    """Written table of the documents (doc_id, tie, node, n, signature) and, in
    rows of their own, the frequency counts (bucket, times) of each task."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        names = ["doc_id", "tie", "node", "n", "signature", "bucket", "times"]
        id_type = None
        for b in batches:
            raw, at = common.raw_text(b.column("text"))
            id_type = b.column("doc_id").type
            for lo, hi, part, off in common.slices(raw, at):
                got, nodes = sets(part, off)
                if got:
                    every = np.concatenate(got)
                    total += np.bincount((every >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
                m = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, m), b.column("tie").slice(lo, m), pa.array(nodes.view(np.int64)), pa.array([len(x) for x in got], pa.int64()), pa.array([signature(x).tobytes() if len(x) else b"" for x in got], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())],
                    names,
                )
        if id_type is not None:
            full = np.flatnonzero(total)
            for lo in range(0, len(full), 1 << 16):
                k = full[lo : lo + (1 << 16)]
                no = pa.nulls(len(k), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(k), id_type), no, no, no, pa.nulls(len(k), pa.binary()), pa.array(k, pa.int32()), pa.array(total[k])], names)

    texts = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return common.written(texts.mapInArrow(run, f"doc_id {kind}, tie long, node long, n long, signature binary, bucket int, times long"), "sets")


def _classes(table: DataFrame) -> tuple[np.ndarray, float]:
    """Frequency class of each bucket, half-powers of two above the mean, and the mean."""
    rows = table.where("bucket is not null").groupBy("bucket").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(1 << COUNT_BITS)
    times[rows.column("bucket").to_numpy()] = rows.column("times").to_numpy()
    mean = max(times.mean(), 1.0)
    return np.floor(2 * np.log2(np.maximum(times / mean, 1.0))).clip(0, 200).astype(np.uint64), mean


def _levels(docs: DataFrame, tokens_in_all: int) -> np.ndarray:
    """Map of the tokens' levels. Each group of the count owns a range of the map
    and gives its entries; together they are the map, of a bounded size."""
    bits = min(MOST_LEVEL_BITS, max(16, tokens_in_all.bit_length() - 2))
    groups = 8
    while groups * 500_000 < tokens_in_all and groups < 1 << (bits - 4):
        groups *= 2
    width = (1 << bits) // groups
    shift = np.uint64(64 - bits)

    def entries(batches):
        held, rows = [], 0

        def flush():
            every, times = np.unique(mix(np.concatenate(held) ^ _SEEDS[0]), return_counts=True)
            times = np.minimum(times, LEVELS[-1]).astype(np.uint8)  # more tell no more
            part = (every >> shift).astype(np.int64) // width
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(cut[1:], len(part))
            cells = [[packed(every[a:z]) for a, z in zip(cut, ends)], [times[a:z].tobytes() for a, z in zip(cut, ends)]]
            return pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int64()), *(pa.array(x, pa.binary()) for x in cells)], ["part", "entries", "times"])

        for b in batches:
            raw, at = common.raw_text(b.column("text"))
            for _, _, piece, off in common.slices(raw, at):
                got = sets(piece, off)[0]
                held += got
                rows += sum(map(len, got))
                if rows > 2 * FLUSH_ENTRIES:
                    yield flush()
                    held, rows = [], 0
        if rows:
            yield flush()

    def counted(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        every = np.concatenate([unpacked(x.as_buffer()) for x in table.column("entries")])
        times = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("times")])
        order = np.argsort(every, kind="stable")
        every = every[order]
        head = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        level = np.searchsorted(LEVELS, np.add.reduceat(times[order].astype(np.int64), head), "right").astype(np.uint8)
        some = level > 0
        own = np.zeros(width, np.uint8)
        np.maximum.at(own, (every[head[some]] >> shift).astype(np.int64) - part * width, level[some])
        own = own.reshape(-1, 4)
        return pa.table({"part": pa.array([part], pa.int64()), "levels": pa.array([(own[:, 0] | own[:, 1] << 2 | own[:, 2] << 4 | own[:, 3] << 6).tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(entries, "part long, entries binary, times binary").groupBy("part").applyInArrow(counted, "part long, levels binary")
    out = np.zeros((1 << bits) // 4, np.uint8)
    for r in common.written(parts, "levels").collect():  # at most the map: 2^27 entries of two bits, 32 MB
        out[r["part"] * width // 4 : (r["part"] + 1) * width // 4] = np.frombuffer(r["levels"], np.uint8)
    return out


_ENTRY = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<i4"), ("known", "<i4"), ("hub", "<u2"), ("parts", "<u2")])
_LISTS = "a long, b long, n long, known long, token long, hub long"


def _may(n, m, known_n, known_m):
    """Whether sets of such sizes, with so many tokens that others hold, may link."""
    return (9 * np.minimum(known_n, known_m) >= 4 * (n + m)) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))


def _candidates(docs: DataFrame, orders, groups: int) -> DataFrame:
    """Written table: pairs with hubs (a < b), members of lists of three or more
    and of all parts of split lists (a, n, known, token), and of the parts' hubs
    again, with how well they serve as such (hub)."""

    def index(batches):
        held: list[np.ndarray] = []
        rows = 0

        def flush():
            every = np.concatenate(held)
            every = every[np.lexsort((every["node"], every["token"]))]
            every = every[np.append(True, (every["token"][1:] != every["token"][:-1]) | (every["node"][1:] != every["node"][:-1]))]
            part = (mix(every["token"] + _salt(every)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            every, part = every[order], part[order]
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(cut[1:], len(part))
            return pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int64()), pa.array([every[a:z].tobytes() for a, z in zip(cut, ends)], pa.binary())], ["part", "entries"])

        for b in batches:
            raw, at = common.raw_text(b.column("text"))
            for _, _, piece, off in common.slices(raw, at):
                got, nodes = sets(piece, off)
                seen = set()
                for x, node in zip(got, nodes.tolist()):
                    if len(x) and node not in seen:
                        seen.add(node)
                        shared = orders.value.shared(x)
                        if shared < needed(len(x)):
                            continue
                        p = orders.value.prefix(x, 0)
                        p = p[orders.value.level(p) > 0]  # a token that no other document holds finds none
                        e = np.empty(len(p), _ENTRY)
                        e["token"], e["node"], e["n"], e["known"], e["hub"] = p, np.uint64(node).astype(np.int64), len(x), shared, 65535 * shared // len(x)
                        e["parts"] = orders.value.parts(p)
                        held.append(e)
                        rows += len(e)
                if rows > FLUSH_ENTRIES:
                    yield flush()
                    held, rows = [], 0
        if held:
            yield flush()

    def lists(table: pa.Table) -> pa.Table:
        every = np.concatenate([np.frombuffer(x.as_buffer(), _ENTRY) for x in table.column("entries")])
        del table
        salt = _salt(every)
        order = np.lexsort((mix(every["node"].copy().view(np.uint64)), ~every["hub"], salt, every["token"]))
        every, salt = every[order], salt[order]
        token, node = every["token"], every["node"]
        fresh = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
        every, salt = every[fresh], salt[fresh]
        token, node, split, hub = every["token"].copy(), every["node"].copy(), every["parts"] > 1, every["hub"].copy()
        n, known = every["n"].astype(np.int64), every["known"].astype(np.int64)
        del every, fresh, order
        head = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])))
        size = np.diff(np.append(head, len(token)))
        of = np.repeat(np.arange(len(head)), size)
        a, b = head[of], np.arange(len(token))
        keep = (node[a] != node[b]) & _may(n[a], n[b], known[a], known[b])
        a, b = node[a[keep]], node[b[keep]]
        both = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
        both = np.unique(both, axis=0) if len(both) else both
        i = np.append(np.flatnonzero((size[of] > 2) | split), head[split[head]])
        m, hubs = len(both), int(split[head].sum())
        tail = np.arange(m + len(i))
        none = np.zeros(m, np.int64)
        return pa.table(
            {
                "a": np.concatenate([both[:, 0], node[i]]),
                "b": pa.array(np.concatenate([both[:, 1], node[i]]), mask=tail >= m),
                "n": np.concatenate([none, n[i]]),
                "known": np.concatenate([none, known[i]]),
                "token": pa.array(np.concatenate([none, token[i].view(np.int64)]), mask=tail < m),
                "hub": pa.array(np.concatenate([none, hub[i].astype(np.int64)]), mask=tail < m + len(i) - hubs),
            }
        )

    parts = docs.select("text").mapInArrow(index, "part long, entries binary")
    return common.written(parts.groupBy("part").applyInArrow(lists, _LISTS), "candidates")


def _salt(entries: np.ndarray) -> np.ndarray:
    """The part of its token's list that each entry is in."""
    return mix(entries["node"].copy().view(np.uint64) ^ _SEEDS[1]) % np.maximum(entries["parts"], 1).astype(np.uint64)


def _hub_pairs(found: DataFrame) -> DataFrame:
    """Pairs of the hubs of a split list's parts with the first hub of the list.
    A list has no more hubs than parts."""
    hubs = found.where("hub is not null").select("token", F.struct((-F.col("hub")).alias("h"), F.xxhash64("a").alias("t"), "a", "n", "known").alias("x"))
    tops = hubs.groupBy("token").agg(F.min("x").alias("top"))
    both = hubs.join(tops, "token").where("x.a != top.a AND 9 * least(x.known, top.known) >= 4 * (x.n + top.n) AND 5 * least(x.n, top.n) >= 4 * greatest(x.n, top.n)")
    return both.select(F.least("x.a", "top.a").alias("a"), F.greatest("x.a", "top.a").alias("b"))


def _filtered(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Written table of the pairs that the signatures allow."""
    pairs = common.written(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # one row a set first, combined within the tasks: copies of one set may be many
    known = members.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("signature").alias("signature")).join(nodes, "node", "left_semi")
    known = common.written(known, "signatures")

    def allowed(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            sizes = zip(b.column("n_a").to_pylist(), b.column("n_b").to_pylist())
            for k, (x, y, (n, m)) in enumerate(zip(b.column("s_a"), b.column("s_b"), sizes)):
                ok[k] = may_link(np.frombuffer(x.as_buffer(), "<u4"), n, np.frombuffer(y.as_buffer(), "<u4"), m)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])

    side = lambda c: known.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    return common.written(both.mapInArrow(allowed, "a long, b long"), "allowed")


def _tokens(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Written table of the sets of the given nodes (and of a few others): node, tokens."""
    spark = docs.sparkSession
    wanted = common.written(reps.join(nodes, "node"), "wanted")
    many = wanted.count()
    size = 1 << min(MOST_WANTED_BITS, max(WANTED_BITS, (8 * many).bit_length()))
    place = lambda: F.pmod(F.xxhash64("doc_id", "tie"), F.lit(size)).cast("int").alias("place")
    cells = wanted.select(place()).groupBy(F.shiftright("place", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT)))").alias("v"))
    bits = np.zeros(size // 64, np.int64)
    got = cells.toArrow()  # at most a 64th of the map's size in rows
    bits[got.column("k").to_numpy()] = got.column("v").to_numpy()
    held = spark.sparkContext.broadcast(bits)

    def find(batches):
        for b in batches:
            p = b.column("place").to_numpy()
            b = b.filter(pa.array((held.value[p >> 6] >> (p & 63)) & 1 == 1))
            if not b.num_rows:
                continue
            raw, at = common.raw_text(b.column("text"))
            for lo, hi, piece, off in common.slices(raw, at):
                got, own = sets(piece, off)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array([packed(x) for x in got], pa.binary())], ["node", "tokens"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").select(place(), "text")
    found = common.written(texts.mapInArrow(find, "node long, tokens binary"), "tokens")
    times = found.groupBy("node").agg(F.count("*").alias("times")).where("times > 1")
    if times.isEmpty():
        return found
    return common.written(found.dropDuplicates(["node"]), "tokens")  # equal sets of wanted places, or rows that repeat


def _verified(docs: DataFrame, members: DataFrame, reps: DataFrame, pairs: DataFrame, orders) -> DataFrame:
    """Written table of the pairs (a, b) that link."""
    pairs = _filtered(members, pairs)
    found = _tokens(docs, reps, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())

    def verify(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column("tokens_a"), b.column("tokens_b"))):
                ok[k] = links(unpacked(x.as_buffer()), unpacked(y.as_buffer()), orders.value)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])

    side = lambda c: found.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    return common.written(pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a").mapInArrow(verify, "a long, b long"), "links")


def join(docs: DataFrame, list_part: int = LIST_PART) -> DataFrame:
    """Written table: doc_id, tie (hash of the text), n_shingles, component_id,
    keep (first row of its component by id, then tie; true for empty sets)."""
    with common.scratch(docs.sparkSession):
        return _joined(docs, list_part)


def _joined(docs: DataFrame, list_part: int) -> DataFrame:
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select("doc_id", common.text_of().alias("text"))
    table = _counted(docs)
    members = table.where("bucket is null").select("doc_id", "tie", "node", "n", "signature")
    whole, total = members.agg(F.sum("n"), F.sum(F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1)).first()
    whole, total = whole or 0, total or 0
    classes, mean = _classes(table)
    held = spark.sparkContext.broadcast(Orders(classes, _levels(docs, whole), mean, list_part))
    groups = max(2 * common.partitions(spark), -(-total // GROUP_ENTRIES))
    found = _candidates(docs, held, groups)
    reps = members.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "tie")).alias("r")).select("node", "r.doc_id", "r.tie")
    pairs = found.where("token is null").select("a", "b").unionByName(_hub_pairs(found)).distinct()
    links = _verified(docs, members, reps, pairs, held)
    listed = found.where("token is not null and hub is null").select(F.col("a").alias("node"), "n", "known", "token")
    if not listed.isEmpty():
        links = links.unionByName(_across(docs, reps, listed, links))
    labels = components(links)
    whole = join_unique(members, labels, ["node"], "left").select("doc_id", "tie", "n", F.coalesce("label", "node").alias("label"))
    alone = whole.where("n = 0").select("doc_id", "tie", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("keep"))
    whole = common.written(whole.where("n > 0"), "labelled")
    first = whole.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("f"))
    grouped = join_unique(whole, first, ["label"]).select(
        "doc_id", "tie", "n", "component_id", (F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("tie") == F.col("f.tie"))).alias("keep")
    )
    return common.written(grouped.unionByName(alone).withColumnRenamed("n", "n_shingles"), "components", keep=True)


def _across(docs: DataFrame, reps: DataFrame, listed: DataFrame, links: DataFrame) -> DataFrame:
    """Links between members of one list that are in different components.

    Lists with the same main component are one group: its outsiders against those
    members whose size lets them link (bands of sizes, each with its neighbours),
    in blocks of some outsiders by some members, so that a set travels once a block
    and no pair is written. Within a block the overlaps of
    an outsider with all members come from the members' tokens in order."""
    labels = components(links)
    listed = common.written(join_unique(listed, labels, ["node"], "left").select("token", "node", "n", "known", F.coalesce("label", "node").alias("label")), "listed")
    sizes = listed.groupBy("token", "label").agg(F.count("*").alias("m"))
    mains = sizes.groupBy("token").agg(F.max(F.struct("m", "label")).alias("x"), F.count("*").alias("labels")).where("labels > 1").select("token", F.col("x.label").alias("main"))
    mixed = join_unique(listed, mains, ["token"]).select("main", "node", "n", "known", "label").distinct()
    mixed = common.written(mixed.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("long")), "mixed")
    if mixed.isEmpty():
        return links.limit(0)
    tokens = _tokens(docs, reps, mixed.select("node").distinct())
    outside = F.col("label") != F.col("main")
    near = mixed.where(outside).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    counts = near.groupBy("main", "band").agg(F.ceil(F.count("*") / OUTSIDERS).alias("cols"))
    counts = counts.join(mixed.groupBy("main", "band").agg(F.ceil(F.count("*") / MEMBERS).alias("rows")), ["main", "band"])
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    col, row = F.pmod(F.xxhash64("node"), "cols").alias("col"), F.pmod(F.xxhash64("node", F.lit(1)), "rows").alias("row")
    mine = join_unique(near, counts, ["main", "band"]).select("main", "band", "node", "n", "known", "label", col, upto("rows").alias("row"), F.lit(True).alias("out"))
    every = join_unique(mixed, counts, ["main", "band"]).select("main", "band", "node", "n", "known", "label", upto("cols").alias("col"), row, F.lit(False).alias("out"))
    blocks = common.written(mine.unionByName(every), "blocks")
    buckets = max(common.partitions(docs.sparkSession), blocks.count() // 4000)
    blocks = blocks.join(tokens.hint("merge"), "node").withColumn("bucket", F.pmod(F.xxhash64("main", "band", "col", "row"), F.lit(buckets)))

    def compare(table: pa.Table) -> pa.Table:
        main, band, col, row = (table.column(c).to_numpy() for c in ("main", "band", "col", "row"))
        node, n, known, label = (table.column(c).to_numpy() for c in ("node", "n", "known", "label"))
        out = np.asarray(table.column("out"))
        data = table.column("tokens")
        order = np.lexsort((row, col, band, main))
        cut = np.flatnonzero(np.append(True, np.any([np.diff(x[order]) != 0 for x in (main, band, col, row)], axis=0)))
        a, b = [], []
        for lo, hi in zip(cut, np.append(cut[1:], len(order))):
            block = order[lo:hi]
            ours, theirs = block[out[block]], block[~out[block]]
            if not len(ours) or not len(theirs):
                continue
            sets_of = [unpacked(data[int(k)].as_buffer()) for k in theirs]
            whole = np.concatenate(sets_of)
            owner = np.repeat(np.arange(len(theirs)), [len(x) for x in sets_of])
            by = np.argsort(whole, kind="stable")
            whole, owner = whole[by], owner[by]
            for o in ours.tolist():
                may = (label[theirs] != label[o]) & _may(n[theirs], n[o], known[theirs], known[o])
                if not may.any():
                    continue
                x = unpacked(data[o].as_buffer())
                first, last = np.searchsorted(whole, x), np.searchsorted(whole, x, "right")
                both = np.bincount(owner[ranges(first, last - first)], minlength=len(theirs))
                for k in np.flatnonzero(may & (5 * both >= 4 * (n[theirs] + n[o] - both))).tolist():
                    a.append(min(node[o], node[theirs[k]]))
                    b.append(max(node[o], node[theirs[k]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return common.written(blocks.groupBy("bucket").applyInArrow(compare, "a long, b long").distinct(), "links")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: the first by id (nulls last), then by
    hash of the text; of rows that repeat both, one. Empty sets all stay."""
    found = join(docs)
    docs, back = common.plain(docs, "doc_id", "text")
    chosen = found.where("keep").groupBy(F.col("doc_id").alias("_chosen_id"), F.col("tie").alias("_chosen_tie")).agg(F.count("*").alias("_times"), F.max("n_shingles").alias("_n"))
    tie = F.xxhash64(common.text_of())
    kept = docs.join(chosen.select("_chosen_id", "_chosen_tie").hint("merge"), docs["doc_id"].eqNullSafe(F.col("_chosen_id")) & (tie == F.col("_chosen_tie")), "left_semi")
    if chosen.where("_times > 1 and _n > 0").isEmpty():
        return back(kept)
    blank = kept.where(~common.text_of().rlike(r"[^ \t-\r]"))
    return back(kept.where(common.text_of().rlike(r"[^ \t-\r]")).dropDuplicates(["doc_id", "text"]).unionByName(blank))


#: The same components in DuckDB, by counting the shingles of every pair that
#: shares one.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), e AS (SELECT doc_id, unnest(g) AS g FROM s), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= 80 * (len(a.g) + len(b.g) - c)
), k AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS top FROM s UNION SELECT k.y, r.top FROM r JOIN k ON r.node = k.x)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.top)::BIGINT AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, s.g
"""
