"""Point lookups, projections, filters, searches and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, order: list[str] | None = None, **equal) -> DataFrame:
    """Rows whose columns equal the given values."""
    out = df.where(reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in equal.items())))
    return out.orderBy(*order) if order else out


def top_k(df: DataFrame, k: int, *keys: Column | str) -> DataFrame:
    """First k rows in a total order; give ties an explicit last key."""
    return df.orderBy(*keys).limit(k)


def like_escaped(text: str) -> str:
    """``text`` as a literal inside LIKE."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search(df: DataFrame, text: str, columns: list[str], **equal) -> DataFrame:
    """Case-insensitive substring search over several columns."""
    found = reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{like_escaped(text)}%") for c in columns))
    return lookup(df.where(found), **equal) if equal else df.where(found)


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in another frame."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def concat_search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Lower-cased substring over all fields set end to end."""
    return df.where(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))


def by_name(df: DataFrame, name: str, order: str) -> DataFrame:
    """One row whose name or qualified name matches (F19), in a fixed order."""
    return df.where((F.col("name") == name) | (F.col("qualified_name") == name)).orderBy(order).limit(1)


def chosen_columns(df: DataFrame, wanted: list[str], allowed: set[str]) -> DataFrame:
    """Projection on an allow-list."""
    if bad := sorted(set(wanted) - allowed):
        raise ValueError(f"columns not allowed: {bad}")
    return df.select(*wanted)


def meets_criteria(df: DataFrame, confidence: float = 0.7, impact: float = 0.5, effort: float = 0.8) -> DataFrame:
    """Decisions worth doing (F16)."""
    return df.where((F.col("confidence") >= confidence) & (F.col("impact") >= impact) & (F.col("effort") <= effort))


def two_stage_top(df: DataFrame, first: str, k: int, rescored: Column, tie: str) -> DataFrame:
    """The top k by one score, then put in the order of another (T4)."""
    return df.orderBy(F.desc(first), tie).limit(k).withColumn("rescored", rescored).orderBy(F.desc("rescored"), tie)


def capped_nodes(edges: DataFrame, node: str, weight: str, k: int) -> DataFrame:
    """Edges to the k heaviest nodes only."""
    heavy = edges.groupBy(node).agg(F.sum(weight).alias("total")).orderBy(F.desc("total"), node).limit(k)
    return edges.join(heavy.select(node), node, "left_semi")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, counted in one pass (F20): rule, checked, broken.
    A rule that is null for a row is broken by it."""
    counts = df.agg(F.count("*").alias("checked"), *(F.count_if(~F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("broken")) for k in rules)))
    return counts.select("checked", pairs.alias("x")).select("x.rule", "checked", "x.broken")
