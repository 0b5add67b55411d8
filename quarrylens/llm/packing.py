"""Packing: documents' token ids cut into pieces, pieces packed into sequences.

A document is cut into pieces of the full sequence length and one rest. Full
pieces are sequences of their own; rests are packed by first-fit decreasing
with a tournament tree of bin capacities, independently in groups of a bounded
number of pieces whose order a hash of the piece has shuffled. Token ids do not
leave the task that makes them: a piece's checksum does not depend on its bin.

Null texts are empty texts: one piece with the end id alone. Repeated rows are
packed row by row. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

LENGTH, END_ID = 1024, 0
#: Pieces that one run of first-fit decreasing holds.
GROUP = 16384


class Tournament:
    """The largest free room below each node of a binary tree over bins."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(bins, 1):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size`` and the room left before it."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        had = room[k]
        room[k] = had - size
        bin_ = k - self.leaves
        k //= 2
        while k:
            a, b = room[2 * k], room[2 * k + 1]
            room[k] = a if a > b else b
            k //= 2
        return bin_, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in it of each piece; bins are numbered from 0 without gaps."""
    order = np.argsort(-sizes, kind="stable")
    tree = Tournament(len(sizes), capacity)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, size in zip(order.tolist(), sizes[order].tolist()):
        bins[k], had = tree.first_fit(size)
        offsets[k] = capacity - had
    return bins, offsets


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        coder = tokens.library_coder(vocabulary)
        for b in batches:
            raw, at = common.raw_text(b.column("text"))
            for lo, hi, part, off in common.slices(raw, at):
                ids, cut = coder.encode(part, off)
                n = np.diff(cut) + 1
                ends = np.cumsum(n)
                four = np.full(int(ends[-1]), end_id, "<u4")
                four[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), n - 1)] = ids
                count = -(-n // length)
                doc = np.repeat(np.arange(hi - lo), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * length
                size = np.minimum(length, n[doc] - start)
                first = (ends - n)[doc] + start
                buf = memoryview(four).cast("B")
                crc = [zlib.crc32(buf[4 * a : 4 * z]) for a, z in zip(first.tolist(), (first + size).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[doc])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """The pieces with sequence_id and offset. A sequence is padded to
    ``length`` unless it is as long as a power of two."""
    spark = docs.sparkSession
    groups = max(1, min(-(-docs.count() // group), max(common.partitions(spark), 2048)))
    cut = pieces(docs, length, end_id, vocabulary)
    cut = cut.withColumn("shuffled", F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"))
    cut = cut.repartition(groups, "shuffled").sortWithinPartitions("shuffled", "doc_id", "start", "ids_crc32", "doc_tokens")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        top = TaskContext.get().partitionId() << 40
        used = 0
        held: list[pa.RecordBatch] = []
        rows = 0

        def packed():
            nonlocal used
            table = pa.Table.from_batches(held).combine_chunks()
            size = table.column("length").to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.zeros(len(size), np.int64)
            full = size == length
            sequence[full] = used + np.arange(full.sum())
            used += int(full.sum())
            if not full.all():
                bins, offset[~full] = first_fit_decreasing(size[~full], length)
                sequence[~full] = used + bins
                used += int(bins.max()) + 1
            table = table.append_column("sequence_id", pa.array(top + sequence)).append_column("offset", pa.array(offset))
            yield from table.to_batches()

        for b in batches:
            held.append(b.select(names))
            rows += b.num_rows
            if rows >= group:
                yield from packed()
                held, rows = [], 0
        if rows:
            yield from packed()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
