"""Nearest vectors by cosine, queries in bounded blocks (J25 extension)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries to a block: a block goes to every part of the vectors in turn.
BLOCK = 2048


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """q, key, similarity of the k rows most like each query, itself left out.
    Queries are numbered in blocks of bounded size; each pass over the rows
    takes one block as a matrix and leaves k candidates a query and task."""
    spark = rows.sparkSession
    keyed = queries.select(F.col(key).alias("q"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    n = keyed.count()
    parts = -(-n // block) if n else 0
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(max(2 * parts, 1)))) if parts > 1 else keyed.withColumn("part", F.lit(0))
    out = None
    for part in range(2 * parts if parts > 1 else 1):
        got = keyed.where(F.col("part") == part).select("q", "v").toArrow()
        ids = got.column("q").to_numpy()
        if not len(ids):
            continue
        q = np.array(got.column("v").to_pylist(), np.float64).reshape(len(ids), -1)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        held = spark.sparkContext.broadcast((ids, q))

        def run(batches, held=held):
            ids, q = held.value
            for b in batches:
                v = b.column(vector)
                keys = b.column(key).to_numpy(zero_copy_only=False)
                ok = np.asarray(v.is_valid())
                if not ok.any():
                    continue
                keys = keys[ok]
                x = np.array(v.filter(pa.array(ok)).to_pylist(), np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                s = np.round(q @ x.T, 9)
                s[ids[:, None] == keys[None, :]] = -2
                m = min(k, len(keys))
                for i in range(len(ids)):
                    top = np.lexsort((keys, -s[i]))[:m]
                    top = top[s[i][top] > -2]
                    if len(top):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), ids[i])), pa.array(keys[top]), pa.array(s[i][top])], ["q", key, "similarity"])

        one = rows.select(key, vector).mapInArrow(run, f"q long, {key} long, similarity double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return rows.limit(0).select(F.lit(0).cast("long").alias("q"), key, F.lit(0.0).alias("similarity"))
    ranked = out.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("d"), F.col(key)))), 1, k).alias("x"))
    return ranked.select("q", F.explode("x").alias("x")).select("q", F.col(f"x.{key}").alias(key), (-F.col("x.d")).alias("similarity"))
