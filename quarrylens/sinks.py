"""Sinks and writes (K1-K16): merges by key, JSON, CSV, Markdown, Mermaid."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows without a new version, and the new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def without_orphans(df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent still exists (K3, K8)."""
    return df.join(parents.select(key).distinct(), key, "left_semi")


def emptied(df: DataFrame) -> DataFrame:
    """No rows, same columns (K9)."""
    return df.where(F.lit(False))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Append or replace a table of facts."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


@contextmanager
def transaction(spark: SparkSession, target: str) -> Iterator[str]:
    """A new version of a folder of tables (K11): the block writes into the path
    it is given, and only once it has ended well does the version become the one
    that ``committed`` names; otherwise what was written is deleted. Readers of the
    old version are not disturbed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = lambda p: hadoop.Path(p)
    store = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    name = uuid.uuid4().hex
    try:
        yield f"{target}/{name}"
    except BaseException:
        store.delete(path(f"{target}/{name}"), True)
        raise
    out = store.create(path(f"{target}/_next-{name}"), True)
    out.write(bytearray(name.encode()))
    out.close()
    store.delete(path(f"{target}/_current"), False)
    if not store.rename(path(f"{target}/_next-{name}"), path(f"{target}/_current")):
        raise OSError(f"could not commit {target}")


def committed(spark: SparkSession, target: str) -> str | None:
    """The path of the version last committed; null if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_current")
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return None
    reader = store.open(where)
    try:
        return f"{target}/" + "".join(chr(reader.read()) for _ in range(32))
    finally:
        reader.close()


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)


def flat(df: DataFrame, separator: str = "; ") -> DataFrame:
    """Arrays as joined text, structs and maps as JSON, for CSV."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array" and f.dataType.elementType.typeName() not in ("struct", "map", "array"):
            out.append(F.array_join(F.col(f.name).cast("array<string>"), separator).alias(f.name))
        elif kind in ("array", "struct", "map", "variant"):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, limit: int = 50) -> str:
    """The first rows as a Markdown table (K14): a report, hence the limit."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in df.take(limit)])


def mermaid(edges: DataFrame, source: str, target: str, limit: int = 200) -> str:
    """The first edges as a Mermaid graph (K15): a report, hence the limit."""
    rows = edges.select(source, target).distinct().orderBy(source, target).take(limit)
    ids = {n: f"n{k}" for k, n in enumerate(dict.fromkeys(x for r in rows for x in r))}
    text = lambda n: json.dumps(str(n))
    return "\n".join(["graph LR", *(f"  {i}[{text(n)}]" for n, i in ids.items()), *(f"  {ids[a]} --> {ids[b]}" for a, b in rows)])
