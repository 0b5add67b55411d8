"""Aggregations and window-like operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..values import PENALTY_PER_FILE, SEVERITY_PENALTIES, SEVERITY_WEIGHTS, TYPE_PENALTIES

#: Items of a basket that are paired in one part.
BASKET_PART = 1000


def mapped(values: dict, key: Column) -> Column:
    """The value of a key in a small fixed table; null if it has none."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def joined(values: Column, separator: str = ",") -> Column:
    """A sorted list of values as text."""
    return F.array_join(F.sort_array(F.collect_list(values)), separator)


def repeated_groups(df: DataFrame, key: str, member: str, least: int = 2) -> DataFrame:
    """Groups of equal non-blank keys (A1-A3, C2): key, group_size, members (sorted array)."""
    out = df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key)
    return out.agg(F.count("*").alias("group_size"), F.sort_array(F.collect_list(member)).alias("members")).where(F.col("group_size") >= least)


def distribution(df: DataFrame, value: str, above: float) -> DataFrame:
    """Count, least, greatest, mean, and how many lie above a bound (A4). No row
    if there are no rows."""
    out = df.agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.count_if(F.col(value) > above).alias("n_above"))
    return out.where("n > 0").withColumn("share_above", F.col("n_above") / F.col("n"))


def breakdown(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Count by keys with further aggregates."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in aggregates.items()))


def weighted_hotspots(findings: DataFrame, by: str, kind: str, confidence: Column, example: str, order: list[Column], weights: dict[str, float] = SEVERITY_WEIGHTS, examples: int = 5) -> DataFrame:
    """Findings weighed by severity and confidence (A13), the numbers of each
    severity, and the first examples (W3). A severity without a weight counts 1,
    none counts as low, no confidence as 1."""
    weight = F.coalesce(mapped(weights, F.lower(F.coalesce(F.col(kind).cast("string"), F.lit("low")))), F.lit(1.0))
    confidence = F.coalesce(confidence, F.lit(1.0))
    ranked = findings.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    first = ranked.where(F.col("_rank") <= examples).groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", example))), lambda x: x[example]).alias("examples"))
    totals = findings.groupBy(by).agg(F.sum(weight * confidence).alias("score"), F.count("*").alias("n"))
    kinds = findings.groupBy(by, kind).agg(F.count("*").alias("m")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(kind, "m"))).alias("by_severity"))
    return totals.join(kinds, by).join(first, by)


def health_penalty(findings: DataFrame, severity: str, kind: str) -> DataFrame:
    """One row: the sum of all findings' penalties by severity and by type."""
    each = F.coalesce(mapped(SEVERITY_PENALTIES, F.lower(severity)), F.lit(0.0)) + F.coalesce(mapped(TYPE_PENALTIES, F.col(kind)), F.lit(0.0))
    tenths = F.round(each * 10).cast("long")  # whole tenths: the sum does not hang on the order of rows
    return findings.agg((F.coalesce(F.sum(tenths), F.lit(0)) / 10.0).alias("penalty"))


def health_score(penalty: Column, files: Column) -> Column:
    """100 for no penalty, falling towards 0, by the number of files."""
    return 100.0 / (1.0 + penalty / F.greatest(F.greatest(files, F.lit(1)) * PENALTY_PER_FILE, F.lit(1.0)))


def band(value: Column, high: float = 0.8, middle: float = 0.5) -> Column:
    """Confidence bands."""
    return F.when(value >= high, "high").when(value >= middle, "medium").otherwise("low")


def usage_by_name(uses: DataFrame, name: str, file: str, examples: int = 5) -> DataFrame:
    """Uses of a bare name: count, distinct files, first examples."""
    rank = F.dense_rank().over(Window.partitionBy(name).orderBy(file))
    out = uses.withColumn("_r", rank).groupBy(name).agg(F.count("*").alias("n"), F.count_distinct(file).alias("n_files"), F.sort_array(F.collect_set(F.when(F.col("_r") <= examples, F.col(file)))).alias("files"))
    return out


def owner(df: DataFrame, group: list[str], member: str, least: int = 2) -> DataFrame:
    """Groups of ``least`` rows or more and the member most frequent in each, the
    first by name among equals (A20)."""
    counts = df.groupBy(*group, member).agg(F.count("*").alias("_n"))
    out = counts.groupBy(*group).agg(F.sum("_n").alias("n"), F.min_by(member, F.struct(-F.col("_n"), F.col(member))).alias("owner"))
    return out.where(F.col("n") >= least)


def co_occurring(df: DataFrame, basket: str, item: str, least: int = 2) -> DataFrame:
    """Pairs of items in the same baskets, ``least`` times or more (A25, H13). A
    basket of very many items is worked on in parts of ``BASKET_PART``, each
    against the whole basket; items that are in no more than ``least`` - 1 baskets
    go first, since no pair of theirs can count."""
    one = df.select(basket, item).distinct()
    often = one.groupBy(item).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(item)
    one = one.join(often, item, "left_semi")
    parts = one.groupBy(basket).agg(F.ceil(F.count("*") / BASKET_PART).alias("_parts"))
    dealt = one.join(parts, basket)
    left = dealt.select(basket, item, F.pmod(F.xxhash64(item), "_parts").alias("_p"))
    right = dealt.select(basket, F.col(item).alias("_other"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_p"))
    pairs = left.join(right, [basket, "_p"]).where(F.col(item) < F.col("_other"))
    return pairs.groupBy(F.col(item).alias("a"), F.col("_other").alias("b")).agg(F.count("*").alias("times")).where(F.col("times") >= least)


def first_per_group(df: DataFrame, group: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("position") <= n)


def deciles(df: DataFrame, value: str, tie: str, group: list[str]) -> DataFrame:
    """Decile of each row in its group by value."""
    return df.withColumn("decile", F.ntile(10).over(Window.partitionBy(*group).orderBy(value, tie)))


def summary_stats(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, least, greatest and sample deviation."""
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev(value).alias("deviation"))


def unique_targets(df: DataFrame, scope: list[str], symbol: str, holder: str, key: str) -> DataFrame:
    """Names made unique in a scope (W9), rows in order of ``key``: the first of a
    name keeps it; of the others the first with a holder's name has that added, the
    others the first eight letters of their key, and a number from 2 on where even
    those are equal."""
    short = F.substring(F.col(key).cast("string"), 1, 8)
    named = Window.partitionBy(*scope, symbol)
    out = df.withColumn("_first", F.row_number().over(named.orderBy(key)) == 1)
    some = ~F.col("_first") & (F.coalesce(F.col(holder).cast("string"), F.lit("")) != "")
    held = Window.partitionBy(*scope, symbol, holder, "_some").orderBy(key)
    out = out.withColumn("_some", some).withColumn("_held", F.col("_some") & (F.row_number().over(held) == 1))
    rest = out.withColumn("_rest", ~F.col("_first") & ~F.col("_held"))
    again = Window.partitionBy(*scope, symbol, "_rest", short).orderBy(key)
    rest = rest.withColumn("_k", F.row_number().over(again))
    target = (
        F.when(F.col("_first"), F.col(symbol))
        .when(F.col("_held"), F.concat_ws("__", symbol, holder))
        .when(F.col("_k") == 1, F.concat_ws("__", F.col(symbol), short))
        .otherwise(F.concat_ws("__", F.col(symbol), short, F.col("_k").cast("string")))
    )
    return rest.withColumn("target", target).drop("_first", "_some", "_held", "_rest", "_k")
