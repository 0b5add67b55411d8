"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key from which on they are split; at most ``MOST_HOT`` keys are.
HOT_ROWS, MOST_HOT = 2000, 1000


def hot_keys(left: DataFrame, keys: list[str], counts: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> list[tuple]:
    """The keys of ``left`` with more than ``hot_rows`` rows, and how many. The
    bound rises with the table so that no more than ``MOST_HOT`` keys can pass
    it: what comes to the driver is bounded at any size. ``counts`` (keys, n)
    spares the counting where it has been done."""
    rows = left.count() if counts is None else counts.agg(F.sum("n")).first()[0] or 0
    if rows <= hot_rows:
        return []
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count("*").alias("n"))
    return [tuple(r) for r in counts.where(F.col("n") > max(hot_rows, rows // MOST_HOT)).select(*keys, "n").collect()]


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left.join(right, keys, how)`` for a ``right`` of one row a key, by sort
    and merge. The rows of a hot key are dealt over as many parts as they make
    shares of ``hot_rows``, by a hash of the row, and the one row on the right is
    copied into each part; no other row is copied."""
    hot = hot_keys(left, keys, counts, hot_rows)
    if not hot:
        return left.join(right.hint("merge"), keys, how)
    row = lambda key, n: F.struct(*(F.lit(v).cast(left.schema[k].dataType).alias(k) for k, v in zip(keys, key)), F.lit(-(-n // hot_rows)).cast("long").alias("_parts"))
    marks = F.broadcast(left.sparkSession.range(1).select(F.inline(F.array(*(row(key, n) for *key, n in hot)))))  # at most MOST_HOT rows
    dealt = left.join(marks, keys, "left").withColumn("_part", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*left.columns), "_parts")).otherwise(0)).drop("_parts")
    upto = F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1)
    copied = right.join(marks, keys, "left").withColumn("_part", F.explode(upto)).drop("_parts")
    return dealt.join(copied.hint("merge"), [*keys, "_part"], how).drop("_part")
