"""What the training-data operators share: written tables, small Arrow batches,
and bounded slices of Arrow text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import kept_path, scratch, shared_dir, written  # noqa: F401  (used through this module)

#: Texts are worked on in slices of about this many bytes.
SLICE_BYTES = 1 << 19


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Let Arrow batches hold few rows, so that long texts stay bounded. The setting
    is read when a frame is run, not when it is made, so it must stay: a session
    that has a smaller one keeps it."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= rows:
        spark.conf.set(key, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns, but those an operator uses, under names that
    clash with none of its own, and what gives them their names again, in order."""
    names = docs.columns
    safe = [c if c in used else f"column{k}" for k, c in enumerate(names)]
    return docs.toDF(*safe), lambda df: df.select(*(F.col(s).alias(c) for s, c in zip(safe, names)))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_of(name: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def raw_text(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(raw: np.ndarray, at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes (a longer row alone):
    first row, last row + 1, their bytes, their offsets."""
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
