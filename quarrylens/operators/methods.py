"""Grouping of a class's methods."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as G


def duties(methods: DataFrame, key: str, name: str, words: DataFrame) -> DataFrame:
    """Best duty of each method by the words its name holds (M11): words has
    duty, word, weight. Ties go to the first duty by name; none: utility."""
    parts = methods.select(key, F.explode(F.array_distinct(F.split(F.lower(name), "[^a-z0-9]+"))).alias("word"))
    scores = parts.join(words, "word").groupBy(key, "duty").agg(F.sum("weight").alias("score"))
    best = scores.groupBy(key).agg(F.min_by("duty", F.struct(-F.col("score"), F.col("duty"))).alias("duty"), F.max("score").alias("score"))
    return methods.join(best, key, "left").na.fill({"duty": "utility", "score": 0})


def shared_feature_groups(access: DataFrame, scope: str, method: str, feature: str, least: float = 0.6) -> DataFrame:
    """Methods of one scope joined where their features' Jaccard similarity is
    ``least`` or more, in connected groups (G6): method, component. Pairs share a
    feature, so only those are looked at."""
    one = access.select(scope, method, feature).where(F.col(feature).isNotNull()).distinct()
    sizes = one.groupBy(scope, method).agg(F.count("*").alias("_n"))
    other = one.select(scope, feature, F.col(method).alias("_o"))
    both = one.join(other, [scope, feature]).where(F.col(method) < F.col("_o")).groupBy(scope, method, "_o").agg(F.count("*").alias("_b"))
    both = both.join(sizes, [scope, method]).join(sizes.select(scope, F.col(method).alias("_o"), F.col("_n").alias("_m")), [scope, "_o"])
    return G.components(both.where(F.col("_b") / (F.col("_n") + F.col("_m") - F.col("_b")) >= least), method, "_o")


def greedy_groups(methods: DataFrame, scope: str, least: float = 0.2, smallest: int = 2) -> DataFrame:
    """Methods left without a duty, grouped (M11): each in turn begins a group and
    takes in every later one whose mean cohesion with the group is over ``least``;
    groups of ``smallest`` or more are numbered, what is left is utility_support
    (null where that is too small). By nature sequential in one class. methods:
    scope, method, calls, attributes, keywords (arrays), scores (map)."""

    def alike(a, b) -> float:
        def share(c):
            x, y = set(a[c] if a[c] is not None else ()), set(b[c] if b[c] is not None else ())
            return len(x & y) / max(len(x | y), 1)

        one, two = dict(a["scores"] or {}), dict(b["scores"] or {})
        both = [min(one[k], two[k]) / max(one[k], two[k]) for k in one.keys() & two.keys() if one[k] > 0 and two[k] > 0]
        called = b["method"] in set(a["calls"] if a["calls"] is not None else ()) or a["method"] in set(b["calls"] if b["calls"] is not None else ())
        return 0.4 * called + 0.2 * share("attributes") + 0.2 * share("keywords") + 0.2 * max(both, default=0.0)

    def step(pdf):
        rows = pdf.sort_values("method").to_dict("records")
        near = [[alike(a, b) if a is not b else 0.0 for b in rows] for a in rows]
        group, n, used = [None] * len(rows), 0, set()
        for i in range(len(rows)):
            if i in used:
                continue
            mine = [i]
            for j in range(len(rows)):
                if j != i and j not in used and sum(near[k][j] for k in mine) / len(mine) > least:
                    mine.append(j)
            if len(mine) >= smallest:
                n += 1
                used.update(mine)
                for j in mine:
                    group[j] = f"cohesion_group_{n}"
        left = [j for j in range(len(rows)) if j not in used]
        if len(left) >= smallest:
            for j in left:
                group[j] = "utility_support"
        return pd.DataFrame({scope: [r[scope] for r in rows], "method": [r["method"] for r in rows], "group": group})

    return methods.groupBy(scope).applyInPandas(step, f"{scope} {methods.schema[scope].dataType.simpleString()}, method string, group string")


def attached_private(groups: DataFrame, calls: DataFrame, most: int = 20) -> DataFrame:
    """Private methods join the group of the nearest public caller (M12):
    groups: method, group (null for private); calls: caller, callee."""
    out = groups
    for _ in range(most):
        known = out.where(F.col("group").isNotNull()).select(F.col("method").alias("caller"), F.col("group").alias("_g"))
        found = calls.join(known, "caller").groupBy(F.col("callee").alias("method")).agg(F.min("_g").alias("_g"))
        step = G.kept(out.join(found, "method", "left").select("method", F.coalesce("group", "_g").alias("group"), (F.col("group").isNull() & F.col("_g").isNotNull()).alias("_new")))
        out = step.select("method", "group")
        if step.where("_new").isEmpty():
            break
    return out
