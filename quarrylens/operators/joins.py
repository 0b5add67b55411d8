"""Joins of facts: edges, usages, neighbours, prefixes, cascades, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def resolved_edges(edges: DataFrame, nodes: DataFrame, source: str, target: str, external: str, key: str, uid: str) -> DataFrame:
    """Edges with the source's uid and the target's uid or external name."""
    s = nodes.select(F.col(key).alias(source), F.col(uid).alias("source_uid"))
    t = nodes.select(F.col(key).alias(target), F.col(uid).alias("target_uid"))
    out = edges.join(s, source).join(t, target, "left")
    return out.withColumn("target_name", F.coalesce("target_uid", external)).withColumn("is_internal", F.col("target_uid").isNotNull())


def usages(edges: DataFrame, uid: str) -> DataFrame:
    """Edges that lead to a symbol, by uid or by external name."""
    return edges.where((F.col("target_uid") == uid) | (F.col("target_external") == uid))


def used_flags(nodes: DataFrame, edges: DataFrame, key: str, target: str) -> DataFrame:
    """Every node with a flag whether an edge leads to it."""
    hit = edges.select(F.col(target).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("used", F.lit(True))
    return nodes.join(hit, key, "left").withColumn("used", F.coalesce("used", F.lit(False)))


def without(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows without a partner."""
    return left.join(right.select(F.col(right_key).alias("_k")).distinct(), F.col(left_key) == F.col("_k"), "left_anti")


def in_repeated(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Rows whose key stands ``least`` times or more."""
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return df.join(keys.select(key), key, "left_semi")


def representative_pairs(df: DataFrame, key: str, member: str) -> DataFrame:
    """Each later member of a key's group with its first (J11): the group's links
    without its square."""
    keyed = df.where(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min(member).alias("first_member"), F.count("*").alias("group_size")).where("group_size > 1")
    return keyed.join(first, key).where(F.col(member) > F.col("first_member"))


def nested_members(outer: DataFrame, inner: DataFrame, scope: str, outer_name: str, inner_name: str) -> DataFrame:
    """Members whose qualified name lies below an outer name in one scope (J12):
    names' prefixes are exploded, so the join is on equality."""
    prefixes = inner.withColumn("_parts", F.split(inner_name, r"\.")).withColumn("_p", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_parts") - 1, F.lit(1)))))
    prefixes = prefixes.where(F.size("_parts") > F.col("_p")).withColumn("_prefix", F.array_join(F.slice("_parts", 1, F.col("_p")), "."))
    return outer.join(prefixes.drop("_parts", "_p"), (outer[scope] == prefixes[scope]) & (outer[outer_name] == prefixes["_prefix"])).drop(prefixes[scope])


def fan_in(edges: DataFrame, target: str, source: str, name: str = "fan_in") -> DataFrame:
    """Distinct sources by target (the decorrelated subquery of J17)."""
    return edges.groupBy(target).agg(F.count_distinct(source).alias(name))


def edge_neighbors(edges: DataFrame, here: str, there: str, forward: str, backward: str) -> DataFrame:
    """Both directions of edges between different nodes (J7, U4): node,
    neighbor, relation, and the edge's other columns."""
    rest = [c for c in edges.columns if c not in (here, there)]
    out = edges.where(F.col(here) != F.col(there))
    a = out.select(F.col(here).alias("node"), F.col(there).alias("neighbor"), F.lit(forward).alias("relation"), *rest)
    b = out.select(F.col(there).alias("node"), F.col(here).alias("neighbor"), F.lit(backward).alias("relation"), *rest)
    return a.unionByName(b)


def equal_or_below(df: DataFrame, column: str, module: str) -> DataFrame:
    """Names equal to a module or below it (J6), dots and underscores literal."""
    return df.where((F.col(column) == module) | F.col(column).startswith(module + "."))


def longest_prefix(df: DataFrame, name: str, known: DataFrame, prefix: str, value: str, separator: str, trims: int) -> DataFrame:
    """The value of the longest known prefix of a name (J19), ``trims`` parts
    shorter at most; only prefixes that one row alone has are known. Names
    without one have a null value."""
    unique = known.groupBy(F.col(prefix).alias("_prefix")).agg(F.min(value).alias("_value"), F.count("*").alias("_n")).where("_n = 1")
    parts = F.split(name, "\\Q" + separator + "\\E")
    tried = df.select(name).distinct().withColumn("_parts", parts).withColumn("_depth", F.explode(F.sequence(F.lit(0), F.least(F.lit(trims), F.size("_parts") - 1))))
    tried = tried.withColumn("_prefix", F.array_join(F.slice("_parts", 1, F.size("_parts") - F.col("_depth")), separator))
    found = tried.join(unique, "_prefix").groupBy(name).agg(F.min_by("_value", "_depth").alias(value), F.min_by("_prefix", "_depth").alias("matched_prefix"))
    return df.join(found, name, "left")


def cascade(df: DataFrame, key: str, rules: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """First rule that has an answer wins (J22, J23): each rule's frame holds
    (key, value); rows without an answer have null value and rule."""
    found = None
    for k, (rule, answers) in enumerate(rules):
        one = answers.select(key, F.col(value).alias("_v"), F.lit(k).alias("_p"), F.lit(rule).alias("_r"))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy(key).agg(F.min(F.struct("_p", "_r", "_v")).alias("_b"))
    return df.join(best, key, "left").withColumn(value, F.col("_b._v")).withColumn("rule", F.col("_b._r")).drop("_b")


def unique_names(nodes: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Names that one node alone has within a scope."""
    return nodes.groupBy(*scope).agg(F.min(key).alias(key), F.count("*").alias("_n")).where("_n = 1").drop("_n")


def near_in_time(df: DataFrame, group: str, at: str, key: str, seconds: int) -> DataFrame:
    """Pairs of one group at most ``seconds`` apart (J24 as a range join): each
    row meets its own bin and the next, so the join is on equality."""
    epoch = F.unix_micros(F.col(at).cast("timestamp"))
    binned = df.select(group, key, epoch.alias("_t")).withColumn("_bin", F.floor(F.col("_t") / (seconds * 1_000_000)))
    left = binned.select(group, F.col(key).alias("a"), F.col("_t").alias("ta"), F.explode(F.array("_bin", F.col("_bin") + 1)).alias("_bin"))
    right = binned.select(group, F.col(key).alias("b"), F.col("_t").alias("tb"), "_bin")
    later = (F.col("tb") > F.col("ta")) | ((F.col("tb") == F.col("ta")) & (F.col("b") > F.col("a")))
    return left.join(right, [group, "_bin"]).where(later & (F.col("tb") - F.col("ta") <= seconds * 1_000_000)).select(group, "a", "b", (F.col("tb") - F.col("ta")).alias("micros"))


def overlapping(findings: DataFrame, near: int = 10) -> DataFrame:
    """Findings of one file that overlap in lines or start at most ``near`` lines
    apart (J24): a, b with a before b. Findings of one type in a file are a
    group of their own (``same_type_groups``) rather than all its pairs."""
    span = findings.select("file_path", "finding_id", "line_start", F.greatest("line_end", "line_start").alias("line_end"))
    left = span.select("file_path", F.col("finding_id").alias("a"), F.col("line_start").alias("a0"), F.col("line_end").alias("a1"))
    left = left.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("a0") - near) / 64), F.floor((F.greatest("a1", F.col("a0") + near)) / 64))))
    right = span.select("file_path", F.col("finding_id").alias("b"), F.col("line_start").alias("b0"), F.col("line_end").alias("b1"))
    right = right.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("b0") / 64), F.floor(F.col("b1") / 64))))
    close = ((F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1"))) | (F.abs(F.col("a0") - F.col("b0")) <= near)
    return left.join(right, ["file_path", "_bin"]).where((F.col("a") < F.col("b")) & close).select("file_path", "a", "b").distinct()


def same_type_groups(findings: DataFrame) -> DataFrame:
    """Findings of one type in one file (J24's third condition)."""
    return findings.groupBy("file_path", "finding_type").agg(F.sort_array(F.collect_list("finding_id")).alias("members"), F.count("*").alias("n")).where("n > 1")


def suffix_join(absolute: DataFrame, relative: DataFrame, path: str, suffix: str) -> DataFrame:
    """Absolute paths with the longest relative path that ends them (J18), by
    equality on every suffix of the path; null if none."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    tails = absolute.select(path).distinct().withColumn("_parts", parts).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_parts"))))
    tails = tails.withColumn("_tail", F.array_join(F.slice("_parts", F.col("_k"), F.size("_parts")), "/"))
    found = tails.join(relative.select(F.col(suffix).alias("_tail")).distinct(), "_tail").groupBy(path).agg(F.min_by("_tail", "_k").alias(suffix))
    return absolute.join(found, path, "left")


def blocked_pairs(df: DataFrame, key: str, blocks: Column, most: int) -> DataFrame:
    """Candidate pairs that share a block value, of blocks of at most ``most``
    members (J26, W7: larger blocks say nothing)."""
    entries = df.select(key, F.explode(F.array_distinct(blocks)).alias("_b"))
    fits = entries.groupBy("_b").agg(F.count("*").alias("_n")).where(F.col("_n").between(2, most)).select("_b")
    kept = entries.join(fits, "_b")
    other = kept.select(F.col(key).alias("_other"), "_b")
    return kept.join(other, "_b").where(F.col(key) < F.col("_other")).select(F.col(key).alias("a"), F.col("_other").alias("b")).distinct()


def similar_sets(df: DataFrame, key: str, members: Column, tenths: int) -> DataFrame:
    """All pairs of sets whose Jaccard similarity is at least ``tenths`` / 10: a,
    b, similarity, with a before b (C12, C22, exactly). Equal sets are one, the
    least key's; each of the others is given with that one. Empty sets and null
    keys give no pair; keys do not repeat. Members are compared by 64-bit hashes.

    Members stand in one order, rarest first, so two sets that are alike share
    ``most`` members or all they must share within their prefixes. A set is
    indexed under the level of its size with the prefix it needs for larger
    partners, and sought on the levels of possible smaller partners. Pairs with
    so many shared members are verified on the whole sets."""
    given = df.select(F.col(key).alias("_key"), F.array_sort(F.array_distinct(members)).alias("_s")).where("_key IS NOT NULL AND size(_s) > 0")
    given = given.select("_key", F.sha2(F.to_json("_s"), 256).alias("_g"), F.transform("_s", lambda x: F.xxhash64(x)).alias("_h"))
    sets = written(given.groupBy("_g").agg(F.min("_key").alias("_k"), F.first("_h").alias("_h")), "sets")
    same = given.select("_key", "_g").join(sets.select("_g", "_k"), "_g").where("_key > _k")
    same = same.select(F.col("_k").alias("a"), F.col("_key").alias("b"), F.lit(1.0).alias("similarity"))

    each = sets.select("_k", F.size("_h").alias("_n"), F.explode("_h").alias("_w"))
    shared = each.groupBy("_w").agg(F.count("*").alias("_f")).where("_f > 1")  # no link can rest on the others, which come first
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_f", "_w"))), lambda x: x["_w"])
    ranked = written(each.join(shared, "_w").groupBy("_k", "_n").agg(ordered.alias("_o")), "ranked")

    level = lambda n: f"CAST(floor(ln({n}) / ln({10 / tenths!r}D)) AS INT)"
    low = f"CAST(floor(pow({10 / tenths!r}D, _l)) AS INT)"
    most = f"(3 + {low} DIV 50)"
    need = lambda total: f"(({tenths} * ({total}) + {9 + tenths}) DIV {10 + tenths})"
    least = f"(({tenths} * _n + 9) DIV 10)"
    prefix = lambda total: F.expr(f"explode(slice(_o, 1, CAST(greatest(0, size(_o) - {need(total)} + {most}) AS INT)))")
    indexed = ranked.withColumn("_l", F.expr(level("_n"))).select("_l", F.col("_k").alias("a"), F.col("_n").alias("_na"), prefix("2 * _n").alias("_w"))
    sought = ranked.withColumn("_l", F.expr(f"explode(sequence({level(least)}, {level('_n')}))"))
    sought = sought.select("_l", F.col("_k").alias("b"), F.col("_n").alias("_nb"), prefix(f"_n + greatest({least}, {low})").alias("_w"))
    fits = f"(_na < _nb OR (_na = _nb AND a < b)) AND 10 * _na >= {tenths} * _nb"
    met = indexed.join(sought, ["_w", "_l"]).where(fits).select("a", "b", F.expr(f"least({most}, {need('_na + _nb')})").alias("_least"))
    # dealt out by pair before they are counted: hardly any repeats within a task
    likely = written(met.repartition("a", "b").groupBy("a", "b", "_least").agg(F.count("*").alias("_c")).where("_c >= _least").select("a", "b"), "likely")
    side = lambda k, n, o: ranked.select(F.col("_k").alias(k), F.col("_n").alias(n), F.col("_o").alias(o))
    whole = likely.join(side("a", "_na", "_oa"), "a").join(side("b", "_nb", "_ob"), "b").withColumn("_both", F.size(F.array_intersect("_oa", "_ob")))
    near = whole.where(f"{10 + tenths} * _both >= {tenths} * (_na + _nb)")
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("_both") / (F.col("_na") + F.col("_nb") - F.col("_both"))).alias("similarity"))
    return near.unionByName(same)


def named_within(names: DataFrame, name: str, texts: DataFrame, text: str) -> DataFrame:
    """Distinct names that stand anywhere in a text, within longer words too.
    A name made of word characters lies within one word, so every piece of each
    distinct word is joined by equality; only names with other characters need
    the texts themselves."""
    wanted = names.select(F.col(name)).where(F.col(name) != "").distinct()
    plain, odd = wanted.where(F.col(name).rlike(r"^\w+$")), wanted.where(~F.col(name).rlike(r"^\w+$"))
    longest = wanted.agg(F.max(F.length(name))).first()[0] or 0
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0)))).alias("_w")).distinct()
    starts = words.select("_w", F.explode(F.sequence(F.lit(1), F.length("_w"))).alias("_i"))
    sizes = plain.select(F.length(name).alias("_n")).distinct().agg(F.sort_array(F.collect_list("_n"))).first()[0]  # at most as many as the longest name's length
    if not longest or not sizes:
        pieces = words.select(F.col("_w").alias(name)).limit(0)
    else:
        pieces = starts.select(F.explode(F.array(*(F.substring("_w", F.col("_i"), F.lit(n)) for n in sizes))).alias(name)).distinct()
    found = plain.join(pieces, name, "left_semi")
    if odd.isEmpty():
        return found
    return found.unionByName(odd.join(texts.select(F.col(text).alias("_t")), F.col("_t").contains(F.col(name)), "left_semi"))


def name_evidence(symbols: DataFrame, outside: list[DataFrame]) -> DataFrame:
    """Symbols whose bare name stands in any of the given name sets (J27); a
    dotted name counts by its last part."""
    names = None
    for df in outside:
        one = df.select(F.substring_index(F.col(df.columns[0]), ".", -1).alias("name"))
        names = one if names is None else names.unionByName(one)
    return symbols.join(names.distinct(), "name", "left_semi")


def occurrence(df: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Occurrence number within a scope, from 0."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) - 1)
