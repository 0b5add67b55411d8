"""Token-id files: fixed-width bit packing with block offsets.

A file holds blocks of ``BLOCK`` ids, each id in the fewest bits that the
vocabulary needs, then the tables (document ids, their validity and first
positions, blocks' byte offsets) and a footer with their sizes. A block starts
at a byte of its own, so any range of ids can be read and unpacked by numpy
without what lies before it. Files follow one another in ascending doc_id
order (nulls first; equal ids by hash of the text).

Null texts are empty texts, with the end id alone. Repeated rows are written
and read row by row. An empty table gives no files and an empty result. Other
columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

END_ID, VOCABULARY_SIZE = 2, 50257
BLOCK = 1 << 16
#: A task begins a new file when its file holds so many ids.
FILE_IDS = 1 << 25
_MAGIC = b"QLTOKENS"
_FOOTER = struct.Struct("<QQQQII8s")  # documents, ids, blocks, where the tables begin, bits, block, magic


def width(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """64 ids in ``bits`` 64-bit words, the first id in the lowest bits."""
    n = -(-len(ids) // 64)
    rows = np.zeros(n * 64, np.uint64)
    rows[: len(ids)] = ids
    rows = rows.reshape(n, 64)
    out = np.zeros((n, bits), "<u8")
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack_bits(data: bytes, count: int, bits: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        got = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            got = got | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = got & mask
    return out.reshape(-1)[:count].astype(np.uint32)


def _store(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    def __init__(self, path: str, bits: int):
        self.fs, at = _store(path)
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.path, self.bits, self.out = path, bits, self.fs.open_output_stream(at)
        self.held: list[np.ndarray] = []
        self.waiting = self.ids = self.bytes = 0
        self.doc_ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.offsets: list[int] = []

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.offsets.append(self.bytes)
        self.out.write(data)
        self.bytes += len(data)

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids.cast(pa.int64()))
        self.sizes.append(sizes)
        self.held.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= BLOCK:
            ids = np.concatenate(self.held)
            whole = len(ids) // BLOCK * BLOCK
            for lo in range(0, whole, BLOCK):
                self._block(ids[lo : lo + BLOCK])
            self.held, self.waiting = [ids[whole:].copy()], len(ids) - whole

    def close(self) -> tuple[int, int]:
        if self.waiting:
            self._block(np.concatenate(self.held))
        doc_ids = pa.concat_arrays(self.doc_ids)
        sizes = np.concatenate(self.sizes)
        first = np.cumsum(sizes) - sizes
        self.out.write(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        self.out.write(np.asarray(doc_ids.is_valid()).astype(np.uint8).tobytes())
        self.out.write(first.astype("<i8").tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(_FOOTER.pack(len(sizes), self.ids, len(self.offsets), self.bytes, self.bits, BLOCK, _MAGIC))
        self.out.close()
        return len(sizes), self.ids


class Reader:
    """Documents and ranges of ids of one file; only what is asked for is read."""

    def __init__(self, path: str):
        fs, at = _store(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        self.docs, self.ids, blocks, tables, self.bits, self.block, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{path}: not a token file")
        n, data = self.docs, self.file.read_at(size - _FOOTER.size - tables, tables)
        self.doc_ids = np.frombuffer(data, "<i8", n)
        self.valid = np.frombuffer(data, np.uint8, n, 8 * n).astype(bool)
        self.first = np.append(np.frombuffer(data, "<i8", n, 9 * n), self.ids)
        self.offsets = np.append(np.frombuffer(data, "<u8", blocks, 17 * n), np.uint64(tables)).astype(np.int64)

    def read_block(self, k: int) -> np.ndarray:
        lo, hi = int(self.offsets[k]), int(self.offsets[k + 1])
        return unpack_bits(self.file.read_at(hi - lo, lo), min(self.block, self.ids - k * self.block), self.bits)

    def range(self, lo: int, hi: int) -> np.ndarray:
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        ids = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return ids[lo - first * self.block : hi - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.first[k]), int(self.first[k + 1]))

    def checksums(self) -> np.ndarray:
        """crc32 of each document's ids, reading block after block."""
        out, crc, k = np.zeros(self.docs, np.int64), 0, 0
        for b in range(len(self.offsets) - 1):
            base = b * self.block
            buf = memoryview(self.read_block(b).astype("<u4")).cast("B")
            top = base + len(buf) // 4
            while k < self.docs:
                lo, hi = int(self.first[k]), int(self.first[k + 1])
                crc = zlib.crc32(buf[4 * (max(lo, base) - base) : 4 * (min(hi, top) - base)], crc)
                if hi > top:
                    break
                out[k], crc, k = crc, 0, k + 1
        return out

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, path: str, vocabulary: str = tokens.VOCABULARY, vocabulary_size: int = VOCABULARY_SIZE, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids below ``path``; a written table of the files:
    part and file (which order them), path, documents, ids."""
    spark = docs.sparkSession
    common.small_batches(spark)
    bits = width(max(vocabulary_size, end_id + 1))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    keyed = keyed.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(common.partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        coder = tokens.library_coder(vocabulary)
        task = TaskContext.get()
        part, done, out = task.partitionId(), 0, None

        def closed():
            n, ids = out.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": pa.array([done], pa.int64()), "path": [out.path], "docs": [n], "ids": [ids]})

        for b in batches:
            raw, at = common.raw_text(b.column("text"))
            for lo, hi, piece, off in common.slices(raw, at):
                ids, cut = coder.encode(piece, off)
                n = np.diff(cut) + 1
                whole = np.full(int(n.sum()), end_id, np.uint32)
                whole[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), n - 1)] = ids
                if out is None:  # an attempt writes files of its own; only a task's last attempt is listed
                    out = Writer(f"{path}/part-{part:06d}-{done:04d}-{task.taskAttemptId()}.ids", bits)
                out.add(b.column("doc_id").slice(lo, hi - lo), n, whole)
                if out.ids >= FILE_IDS:
                    yield closed()
                    out, done = None, done + 1
        if out is not None:
            yield closed()

    return common.written(ordered.mapInArrow(run, "part long, file long, path string, docs long, ids long"), "files")


def with_starts(files: DataFrame) -> DataFrame:
    """The files with the number of ids before each: sums within runs of 1024
    parts, and over the runs."""
    files = files.withColumn("run", F.floor(F.col("part") / 1024))
    runs = files.groupBy("run").agg(F.sum("ids").alias("run_ids"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("run_ids").over(before), F.lit(0)).alias("run_start"))
    inner = Window.partitionBy("run").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("inner", F.coalesce(F.sum("ids").over(inner), F.lit(0)))
    return files.join(runs, "run").select("path", "docs", "ids", (F.col("run_start") + F.col("inner")).alias("start"))


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    spark = files.sparkSession
    common.ship(spark)

    def run(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                f = Reader(path)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.doc_ids, pa.int64(), mask=~f.valid), pa.array(f.first[:-1] + base), pa.array(np.diff(f.first)), pa.array(f.checksums())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                f.close()

    spread = with_starts(files).repartition(max(1, files.count()))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return read(write(docs, common.kept_path(spark, "tokens")))
