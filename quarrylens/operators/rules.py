"""Rules, smells, scores, unused code and decisions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import values as V
from ..functions.scalar import clamp
from .aggregates import band, mapped

#: An attribute is common if more sets of its class than ``COMMON_SETS``, and than
#: one in ``COMMON_SHARE``, hold it: there bits cost less than rows of a join.
COMMON_SETS, COMMON_SHARE = 32, 100
#: Sets of a block, and attributes in them; pairs compared at once.
BLOCK_SETS, BLOCK_ENTRIES, PAIRS = 16384, 1 << 20, 1 << 17


@dataclass(frozen=True)
class Thresholds:
    """Bounds of the smell rules (M1)."""

    god_methods: int = 15
    god_responsibilities: int = 3
    god_cohesion: float = 0.5
    god_lines: int = 200
    long_lines: int = 30
    long_statements: int = 20
    complexity: int = 10
    nesting: int = 4
    responsibilities: int = 3
    dependencies: int = 5
    envy_ratio: float = 0.7
    envy_accesses: int = 3
    private_accesses: int = 3
    coupling_ratio: float = 0.8


def _points(value: Column, bound: float, twice: float = 2) -> Column:
    """2 beyond ``twice`` the bound, 1 beyond the bound, else 0."""
    return F.when(value > bound * twice, 2).when(value > bound, 1).otherwise(0)


def _level(points: Column) -> Column:
    return F.when(points >= 3, "high").when(points >= 2, "medium").otherwise("low")


def god_class(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Classes with too much in them (M2): any bound broken; severity and
    confidence by how far methods, responsibilities and cohesion are beyond theirs."""
    low = F.when(F.col("cohesion") < t.god_cohesion / 2, 2).when(F.col("cohesion") < t.god_cohesion, 1).otherwise(0)
    points = _points(F.col("method_count"), t.god_methods) + _points(F.col("responsibility_count"), t.god_responsibilities) + low
    broken = (F.col("method_count") > t.god_methods) | (F.col("responsibility_count") > t.god_responsibilities) | (F.col("cohesion") < t.god_cohesion) | (F.col("lines") > t.god_lines)
    severity = F.when(F.col("points") >= 4, "critical").otherwise(_level(F.col("points")))
    confidence = F.least(F.lit(1.0), F.col("points") / 6 + 0.3)
    return df.where(broken).withColumn("points", points).withColumns({"severity": severity, "confidence": confidence, "smell_type": F.lit("god_class")})


def _smells(df: DataFrame, rules: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """One row a smell: rules give whether, severity and confidence."""
    kind = lambda k, c: F.struct(F.lit(k).alias("smell_type"), c[1].alias("severity"), F.least(F.lit(1.0), c[2]).alias("confidence"))
    found = F.explode(F.array_compact(F.array(*(F.when(c[0], kind(k, c)) for k, c in rules.items()))))
    return df.withColumn("_s", found).select("*", "_s.*").drop("_s")


def method_smells(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Long methods, complexity and feature envy (M3, M4, M6), one row a smell.
    Feature envy is a method's, so it needs a class (``in_class``)."""
    long = _points(F.col("lines"), t.long_lines) + _points(F.col("statements"), t.long_statements)
    hard = _points(F.col("complexity"), t.complexity) + _points(F.col("nesting"), t.nesting, 1.5)
    ratio = F.when(F.col("accesses") > 0, F.col("external_accesses") / F.col("accesses")).otherwise(0.0)
    envy = F.when(ratio > 0.9, "high").when(ratio > 0.8, "medium").otherwise("low")
    rules = {
        "long_method": ((F.col("lines") > t.long_lines) | (F.col("statements") > t.long_statements), _level(long), long / 4 + 0.4),
        "high_complexity": ((F.col("complexity") > t.complexity) | (F.col("nesting") > t.nesting), _level(hard), hard / 4 + 0.5),
        "feature_envy": ((ratio > t.envy_ratio) & (F.col("accesses") >= t.envy_accesses) & F.col("in_class"), envy, ratio + 0.2),
    }
    return _smells(df, rules)


def class_smells(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Too many responsibilities, and intimacy with others' private attributes
    (M5, M7), one row a smell. Accesses through self are none of another's."""
    duties, private = F.col("responsibility_count"), F.col("private_accesses")
    srp = F.when(duties > t.responsibilities * 2, "high").when(duties > t.responsibilities, "medium").otherwise("low")
    ratio = F.when(F.col("foreign_accesses") > 0, private / F.col("foreign_accesses")).otherwise(0.0)
    close = F.when(private > t.private_accesses * 2, "high").when(private > t.private_accesses * 1.5, "medium").otherwise("low")
    rules = {
        "srp_violation": ((duties > t.responsibilities) | (F.col("external_dependencies") > t.dependencies), srp, duties / 10 + 0.4),
        "inappropriate_intimacy": ((private > t.private_accesses) & ((ratio > t.coupling_ratio) | (private >= t.private_accesses * 2)), close, private / 10 + 0.3),
    }
    return _smells(df, rules)


def first_match(value: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern that a value matches."""
    out = None
    for pattern, label in rules:
        out = F.when(value.rlike(pattern), label) if out is None else out.when(value.rlike(pattern), label)
    return out.otherwise(default)


def first_word(value: Column, table: dict[str, tuple[str, ...]], default: str | None) -> Column:
    """Label of the first entry of which a word stands in the lower-cased value
    (X12, M9)."""
    out = F.when(F.lit(False), "")
    for label, words in table.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(value).contains(w)
        out = out.when(hit, label)
    return out.otherwise(default)


def name_category(name: Column) -> Column:
    """Semantic category of a name."""
    return first_word(name, V.NAME_CATEGORIES, "business_logic")


def responsibility(name: Column) -> tuple[Column, Column]:
    """A method's responsibility by its name, null if none, and how sure: .8 if
    the name begins with the word that tells it, else .6 (M9)."""
    low, sure = F.lower(name), F.when(F.lit(False), 0.0)
    for words in V.RESPONSIBILITIES.values():
        for w in words:
            sure = sure.when(low.contains(w), F.when(low.startswith(w), 0.8).otherwise(0.6))
    return first_word(name, V.RESPONSIBILITIES, None), sure


def categorised(df: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """First rule by priority (M13, V7). ``rules`` is a configuration table:
    priority, field, pattern, category. It comes to the driver (a rule set is
    written by hand, so it is small) and becomes one expression over the rows:
    no join, no shuffle."""
    wanted = sorted(rules.collect(), key=lambda r: r["priority"])
    chain = None
    for r in wanted:
        hit = F.col(r["field"]).rlike(r["pattern"])
        chosen = F.struct(F.lit(r["category"]).alias("category"), F.lit(r["priority"]).alias("priority"))
        chain = F.when(hit, chosen) if chain is None else chain.when(hit, chosen)
    return df.withColumn("_c", chain).select("*", F.coalesce("_c.category", F.lit("uncategorised")).alias("category"), F.col("_c.priority").alias("rule")).drop("_c")


def tags(lines: Column, complexity: Column, name: Column, module: Column, is_method: Column, callers: Column) -> Column:
    """Sorted tags of a block."""
    low, where = F.lower(name), F.lower(module)
    some = lambda x, *words: sum((F.when(x.contains(w), 1).otherwise(0) for w in words), F.lit(0)) > 0
    marks = (
        F.when(lines > 50, "large").when(lines < 5, "small"),
        F.when(complexity > 10, "complex").when(complexity == 1, "simple"),
        F.when(name.startswith("_"), "private").otherwise("public"),
        F.when(is_method, "method").otherwise("function"),
        F.when(some(low, "test"), "test"),
        F.when(some(low, "legacy", "old", "deprecated"), "legacy"),
        F.when(some(low, "main", "entry", "start"), "entry_point"),
        F.when(some(where, "cli", "command"), "cli"),
        F.when(callers > 5, "hotpath"),
    )
    return F.sort_array(F.array_compact(F.array(*marks)))


def _holds(values: Column, parts: tuple[str, ...]) -> Column:
    """Whether any lower-cased value holds any of the parts."""

    def one(x):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.lower(x).contains(p)
        return hit

    return F.coalesce(F.exists(values, one), F.lit(False))


def has_context(imports: Column, calls: Column, literals: Column, of: dict[str, tuple[str, ...]]) -> Column:
    """Whether imports, calls or literals speak of persistence or serialization."""
    return _holds(imports, of["imports"]) | _holds(calls, of["calls"]) | _holds(literals, of["literals"])


def has_telemetry(calls: Column) -> Column:
    """Whether calls speak of logging (P9), letters' case told apart."""
    part = lambda c: sum((F.when(c.contains(p), 1).otherwise(0) for p in V.TELEMETRY_PARTS), F.lit(0)) > 0
    return F.coalesce(F.exists(calls, lambda c: part(c) | c.isin(*V.TELEMETRY_NAMES)), F.lit(False))


def likely_regex(literal: Column) -> Column:
    """Whether a literal looks like a pattern."""
    sign = sum((F.when(literal.contains(s), 1).otherwise(0) for s in V.REGEX_SIGNS), F.lit(0)) > 0
    return (F.length(literal) >= 3) & (sign | literal.rlike(r"\\\\\w|\([^)]*\)"))


def literal_category(literals: Column) -> Column:
    """category, subcategory of the first literal that tells one: a domain's word,
    a pattern, words of SQL, an address (P9)."""

    def one(x):
        low, out = F.lower(x), F.when(F.lit(False), F.struct(F.lit("").alias("category"), F.lit("").alias("subcategory")))
        pair = lambda c, s: F.struct(F.lit(c).alias("category"), F.lit(s).alias("subcategory"))
        for word, (c, s) in V.LITERAL_DOMAINS.items():
            out = out.when(low.contains(word), pair(c, s))
        some = lambda words: sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0)) > 0
        return out.when(likely_regex(x), pair("parsing", "regex")).when(some(V.SQL_WORDS), pair("persistence", "sql")).when(some(V.URL_SCHEMES), pair("networking", "url"))

    return F.get(F.array_compact(F.transform(literals, one)), F.lit(0))


def cohesion(access: DataFrame, scope: str, method: str, attribute: str) -> DataFrame:
    """Pairs of a class's methods that share an attribute, among all its pairs
    (M8); one for fewer than two methods. A null class has no pairs, a null method
    is none. Methods with the same attributes are one row with a count. Pairs that
    share common attributes are counted on bits, block by block, and make no rows;
    those that share rare ones only come from a join on these."""
    sets = access.select(scope, method, attribute).distinct().groupBy(scope, method).agg(F.sort_array(F.collect_set(attribute)).alias("_a"))
    # a struct is never null, so no branch filters its keys, and all read the same exchange
    sets = sets.groupBy(F.struct(F.col(scope).alias("k")).alias("_k"), "_a").agg(F.count(method).alias("_c"))
    none, some = F.slice("_a", 1, 0), F.col("_common").isNotNull()
    parts = sets.join(_common(sets), "_k", "left").select(
        "_k", "_a", "_c", F.when(some, F.array_intersect("_a", "_common")).otherwise(none).alias("_h"), F.when(some, F.array_except("_a", "_common")).otherwise(F.col("_a")).alias("_r")
    )
    alike = F.when((F.size("_h") == 0) & (F.size("_r") > 0), F.expr("_c * (_c - 1) div 2")).otherwise(0)
    sizes = parts.groupBy("_k").agg(F.sum("_c").alias("n"), F.sum(alike).alias("_same"))
    each = parts.select("_k", F.xxhash64("_a").alias("_s"), "_c", "_h", F.explode("_r").alias("_x"))
    other = each.select("_k", "_x", F.col("_s").alias("_t"), F.col("_c").alias("_d"), F.col("_h").alias("_i"))
    across = each.join(other, ["_k", "_x"]).where((F.col("_s") < F.col("_t")) & ~F.arrays_overlap("_h", "_i")).select("_k", "_s", "_t", "_c", "_d").distinct()
    across = across.groupBy("_k").agg(F.sum(F.col("_c") * F.col("_d")).alias("_across"))
    out = sizes.join(across, "_k", "left").join(_sharing(parts), "_k", "left")
    shared = F.col("_same") + F.coalesce("_across", F.lit(0)) + F.coalesce("_bits", F.lit(0))
    out = out.select(F.col("_k.k").alias(scope), "n", F.when(F.col("_k.k").isNull(), 0).otherwise(shared).alias("shared"))
    return out.withColumn("cohesion", F.when(F.col("n") < 2, 1.0).otherwise(F.col("shared") / (F.col("n") * (F.col("n") - 1) / 2)))


def _common(sets: DataFrame) -> DataFrame:
    """Each class's common attributes: _k, _common (array)."""
    held = sets.select("_k", "_c", F.posexplode_outer("_a").alias("_p", "_x")).groupBy("_k", "_x")
    held = held.agg(F.count("*").alias("_n"), F.count_if(F.coalesce("_p", F.lit(0)) == 0).alias("_sets"), F.sum("_c").alias("_c"))
    listed = F.collect_list(F.when(F.col("_x").isNotNull() & (F.col("_n") > COMMON_SETS), F.struct("_x", "_n")))
    held = held.groupBy("_k").agg(listed.alias("_l"), F.sum("_sets").alias("_sets"), F.sum("_c").alias("_c"))
    common = F.transform(F.filter("_l", lambda y: y["_n"] * COMMON_SHARE > F.col("_sets")), lambda y: y["_x"])
    return held.select("_k", common.alias("_common")).where(F.size("_common") > 0)


def _sharing(parts: DataFrame) -> DataFrame:
    """Pairs that share common attributes (_h): _k, _bits. Sets with the same ones
    are one row with a count; each two blocks of a class's sets make a group."""
    sets = parts.where(F.size("_h") > 0).groupBy("_k", "_h").agg(F.sum("_c").alias("_c"))
    blocks = F.ceil(F.greatest(F.count("_c") / BLOCK_SETS, F.sum(F.size("_h")) / BLOCK_ENTRIES))
    dealt = sets.join(sets.groupBy("_k").agg(blocks.alias("_blocks")), "_k").withColumn("_b", F.pmod(F.xxhash64("_h"), "_blocks"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    dealt = dealt.select("_k", "_h", "_c", "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))

    def compare(table: pa.Table) -> pa.Table:
        block, counts = table.column("_b").to_numpy(), table.column("_c").to_numpy()
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        bits = _bits(table.column("_h"))
        x, c, y, d = bits[block == i], counts[block == i], bits[block == j], counts[block == j]
        step, found = max(1, PAIRS // max(1, len(y))), 0
        for lo in range(0, len(x), step):
            hi = lo + step
            if i != j:
                found += _meeting(x[lo:hi], c[lo:hi], y, d)
            else:  # every two once, and each with itself
                found += _meeting(x[lo:hi], c[lo:hi], y[lo:hi], d[lo:hi]) + 2 * _meeting(x[lo:hi], c[lo:hi], y[hi:], d[hi:])
        if i == j:
            found = (found - int(c.sum())) // 2
        return pa.table({"_k": table.column("_k").slice(0, 1), "_bits": pa.array([found], pa.int64())})

    schema = T.StructType([parts.schema["_k"], T.StructField("_bits", T.LongType())])
    return dealt.groupBy("_k", "_i", "_j").applyInArrow(compare, schema).groupBy("_k").agg(F.sum("_bits").alias("_bits"))


def _bits(sets: pa.ChunkedArray) -> np.ndarray:
    """A row of 64-bit words for each set, a bit for each value that is in any."""
    sets = sets.combine_chunks()
    coded = sets.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), -(-len(coded.dictionary) // 64)
    row = np.repeat(np.arange(len(sets)), pc.list_value_length(sets).to_numpy())
    out = np.zeros(len(sets) * words, np.uint64)
    np.add.at(out, row * words + (code >> 6), np.uint64(1) << (code & 63).astype(np.uint64))  # a set has a value once
    return out.reshape(len(sets), words)


def _meeting(x: np.ndarray, c: np.ndarray, y: np.ndarray, d: np.ndarray) -> int:
    """The sum of c * d over all rows of ``x`` and of ``y`` with a bit in common."""
    if not len(x) or not len(y):
        return 0
    hit = (x[:, :1] & y[:, 0]) != 0
    for w in range(1, x.shape[1]):
        if hit.all():
            break
        hit |= (x[:, w : w + 1] & y[:, w]) != 0
    if c.max() == d.max() == 1:
        return int(np.count_nonzero(hit))
    return int((hit.astype(np.float64) @ d.astype(np.float64)).astype(np.int64) @ c)


def unused_confidence(base: Column, dynamic_import: Column, dynamic: Column) -> Column:
    """Confidence that a symbol is unused (M15): less where its file imports by
    name, or else uses names dynamically in other ways."""
    return base * F.when(dynamic_import, 0.4).when(dynamic, 0.6).otherwise(1.0)


def unused_symbols(symbols: DataFrame, uses: DataFrame, least: float = 0.5, library: bool = False) -> DataFrame:
    """Symbols whose bare name no other file uses (M15, H17), with confidence, type
    and severity. In a library, public symbols and those it exports (``exported``,
    if there is such a column) count as used. symbols: name, file_id, is_public,
    dynamic_import, dynamic; uses: name, file_id."""
    files = uses.groupBy("name").agg(F.count_distinct("file_id").alias("_n"), F.min("file_id").alias("_one"))
    out = symbols.join(files, "name", "left").where(F.col("_n").isNull() | ((F.col("_n") == 1) & (F.col("_one") == F.col("file_id")))).drop("_n", "_one")
    if library:
        out = out.where(~F.col("is_public") & ~(F.coalesce("exported", F.lit(False)) if "exported" in out.columns else F.lit(False)))
    out = out.withColumn("confidence", unused_confidence(F.when(F.col("is_public"), 0.7).otherwise(0.8), F.col("dynamic_import"), F.col("dynamic")))
    out = out.withColumns({"unused_type": F.when(F.col("is_public"), "public_export_unused").otherwise("private_method_unused"), "severity": F.when(F.col("is_public"), "low").otherwise("medium")})
    return out.where(F.col("confidence") >= least)


def dynamic_uses(files: DataFrame, key: str, text: str, most: int = V.MOST_DYNAMIC_SIGNS) -> DataFrame:
    """Signs of dynamic use in sources (M16), the first ``most`` of a file, pattern
    by pattern, as the findings count them: key, sign, pattern number, and the
    module where one is imported by name (else null)."""
    none = F.lit(None).cast("string")
    found = lambda p, group: F.regexp_extract_all(text, F.lit(p), F.lit(group))
    sign = lambda k, s, module: F.struct(F.lit(k).alias("pattern"), s.alias("sign"), module.alias("module"))
    each = lambda k: lambda s: sign(k, s, none)
    pair = lambda k: lambda s, m: sign(k, s, m)
    plain = [F.transform(found(f"(?i)({p})", 1), each(k)) for k, p in enumerate(V.DYNAMIC_USES)]
    named = [F.zip_with(found(f"(?i)({p})", 1), found(f"(?i){p}", 1), pair(k)) for k, p in enumerate(V.DYNAMIC_IMPORTS, len(plain))]
    return files.select(key, F.explode(F.slice(F.concat(*plain, *named), 1, most)).alias("s")).select(key, "s.*")


def dynamic_findings(signs: DataFrame, key: str) -> DataFrame:
    """Uncertain findings of files with dynamic use (M16, H22): confidence .4 where
    a module is imported by name, else .3; always of low severity."""
    by = signs.groupBy(key).agg(F.count("*").alias("n_signs"), F.count("module").alias("n_imports"))
    found = F.col("n_imports") > 0
    name = F.concat(F.when(found, "dynamic_import_").otherwise("dynamic_usage_"), F.substring_index(key, "/", -1))
    return by.select(key, name.alias("symbol_name"), F.lit("uncertain_dynamic").alias("unused_type"), F.when(found, 0.4).otherwise(0.3).alias("confidence"), F.lit("low").alias("severity"), "n_signs", "n_imports")


def criteria(**weights: float) -> dict[str, float]:
    """Weights of the criteria, those given in place of the usual ones, made to
    sum to 1 where they do not within a hundredth (M19)."""
    all_ = V.CRITERIA | weights
    total = sum(all_.values())
    if abs(total - 1.0) <= 0.01:
        return all_
    if total <= 0:
        raise ValueError("weights sum to zero")
    return {k: w / total for k, w in all_.items()}


def priority_score(impact: Column, confidence: Column, effort: Column, risk: Column, performance: Column | float = 0.0, architecture: Column | float = 0.0, weights: dict[str, float] | None = None) -> Column:
    """Priority of a decision: weighted criteria times confidence."""
    w = weights or V.CRITERIA
    lit = lambda x: F.lit(x) if isinstance(x, float) else x
    raw = impact * w["code_quality"] + lit(performance) * w["performance"] + lit(architecture) * w["architecture"] + (1.0 - risk) * w["risk"] + (1.0 - effort) * w["effort"]
    return clamp(raw * confidence)


def priority_bucket(score: Column, confidence: Column, impact: Column) -> Column:
    return F.when((confidence < 0.5) & (impact > 0.6), "deferred").when(score >= 0.9, "critical").when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")


def risk_adjusted(impact: Column, confidence: Column, risk: Column) -> Column:
    """What decisions are ordered by (T5)."""
    return impact * confidence * (1.0 - risk * 0.3)


def clone_decisions(clones: DataFrame) -> DataFrame:
    """Decisions from groups of clones (M17): those not to be extracted with any
    confidence are left out."""
    n = F.col("group_size")
    kept = clones.where(~((F.coalesce("strategy", F.lit("")).isin("", "no_extraction")) & (F.col("extraction_confidence") < 0.5)))
    kind = F.when(F.lit(False), "")
    for part, decision in V.CLONE_DECISIONS.items():
        kind = kind.when(F.col("strategy").contains(part), decision)
    return kept.select(
        kind.otherwise("eliminate_duplicates").alias("decision_type"), F.col("group_id").alias("target"), clamp(F.greatest(F.col("similarity"), F.col("extraction_confidence"), F.lit(0.5))).alias("confidence"),
        clamp(0.3 + n * 0.1).alias("impact"), clamp(0.2 + n * 0.1).alias("effort"), F.when(F.col("clone_type") == "exact", 0.3).otherwise(0.5).alias("risk"), F.greatest(F.lit(0.5), n * 0.5).alias("hours"),
    )


def smell_decisions(smells: DataFrame) -> DataFrame:
    """Decisions from smells by their own type."""
    level = lambda usual, **v: F.coalesce(mapped(v, F.col("severity")), F.lit(usual))
    effort = level(0.5, critical=0.8, low=0.2)
    return smells.select(
        F.coalesce(mapped(V.SMELL_DECISIONS, F.col("smell_type")), F.lit("improve_cohesion")).alias("decision_type"), F.col("target"), clamp(F.coalesce("confidence", F.lit(0.7))).alias("confidence"),
        level(0.5, critical=0.9, high=0.7, low=0.3).alias("impact"), effort.alias("effort"), level(0.3, critical=0.5, high=0.5).alias("risk"), (effort * 8).alias("hours"),
    )


def unused_decisions(unused: DataFrame) -> DataFrame:
    """Decisions from unused symbols of high confidence."""
    sure = unused.where(band(F.col("confidence")) == "high")
    return sure.select(F.lit("remove_unused_code").alias("decision_type"), "target", clamp(F.col("confidence")).alias("confidence"), F.lit(0.6).alias("impact"), F.lit(0.2).alias("effort"), F.lit(0.2).alias("risk"), F.lit(0.5).alias("hours"))


def ranked_decisions(found: DataFrame, least_confidence: float = 0.7, least_impact: float = 0.5, most_effort: float = 0.8, weights: dict[str, float] | None = None) -> DataFrame:
    """Decisions with score and priority (M18), without those that the criteria
    rule out (F16), in order of impact, confidence and risk (T5)."""
    c = F.col
    out = found.withColumn("score", priority_score(c("impact"), c("confidence"), c("effort"), c("risk"), weights=weights))
    out = out.withColumns({"priority": priority_bucket(c("score"), c("confidence"), c("impact")), "rank_score": risk_adjusted(c("impact"), c("confidence"), c("risk"))})
    kept = out.where((c("confidence") >= least_confidence) & (c("impact") >= least_impact) & (c("effort") <= most_effort))
    return kept.orderBy(F.desc("rank_score"), "decision_type", "target")


def decisions(clones: DataFrame, smells: DataFrame, unused: DataFrame) -> DataFrame:
    """Decisions from groups of clones, smells and unused symbols, scored, filtered
    and ranked (M17, M18, F16, T5)."""
    return ranked_decisions(clone_decisions(clones).unionByName(smell_decisions(smells)).unionByName(unused_decisions(unused)))


def steps(plans: DataFrame, recommendation: str = "recommendation") -> DataFrame:
    """Numbered steps of each plan by its recommendation."""
    texts = {
        "MERGE": ("choose the canonical block", "move it to the target", "redirect callers", "delete the copies"),
        "EXTRACT_BASE": ("write the common base", "derive the variants", "redirect callers"),
        "WRAP_ONLY": ("write a wrapper", "delegate to the variants"),
    }
    table = F.create_map(*(x for k, v in texts.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return plans.select("*", F.posexplode(F.element_at(table, F.col(recommendation))).alias("_p", "step")).withColumn("step_no", F.col("_p") + 1).drop("_p")


def quality_score(present: dict[str, float] = V.COMPONENT_WEIGHTS, most: float = 100.0) -> Column:
    """Sum of the weights of the components that an analysis holds."""
    return F.least(F.lit(most), sum((F.when(F.col(c), w).otherwise(0.0) for c, w in present.items()), F.lit(0.0)))


def analysis_risk(call_graph: Column, callers: Column, tests: Column, contracts: Column, n_callers: Column, duplicates: Column, critical: int = 6, high: int = 4, medium: int = 2) -> Column:
    """Risk of a refactoring by what its analysis lacks."""
    points = F.when(~call_graph, 3).otherwise(0) + F.when(~callers, 3).otherwise(0) + F.when(~tests, 2).otherwise(0) + F.when(~contracts, 2).otherwise(0) + F.when(n_callers > 10, 1).otherwise(0) + F.when(duplicates > 5, 1).otherwise(0)
    return F.when(points >= critical, "critical").when(points >= high, "high").when(points >= medium, "medium").otherwise("low")


def opportunities(df: DataFrame, lines: int = 1000, duties: int = 3, config_lines: int = 200, config_duties: int = 4) -> DataFrame:
    """Refactoring opportunities of files (M22); a god class here needs all three
    bounds: file_path, lines, responsibility_count, cohesion, coupling."""
    c = F.col
    named = F.lower("file_path").contains("config") | F.lower("file_path").contains("settings")
    found = {
        "god_class": (c("lines") > lines) & (c("responsibility_count") > duties) & (c("cohesion") < 0.5),
        "large_configuration": named & (c("lines") > config_lines) & (c("responsibility_count") > config_duties),
        "tight_coupling": c("coupling") > 0.7,
        "low_cohesion": c("cohesion") < 0.4,
    }
    return df.withColumn("opportunity", F.explode(F.array_compact(F.array(*(F.when(x, F.lit(k)) for k, x in found.items())))))


def change_risk(files: Column) -> Column:
    """Risk of a breaking change by the files it reaches."""
    return F.when(files > 10, "critical").when(files > 5, "high").when(files > 2, "medium").otherwise("low")


def migration_effort(files: Column) -> Column:
    """Effort of moving callers to a breaking change."""
    return F.when(files > 10, "high").when(files > 3, "medium").otherwise("low")


def test_signal(tests: DataFrame) -> DataFrame:
    """Quality and signal of each test, 0 to 100, and the band of its signal (A33,
    E15): documented, asserts, mocks, trivial, swallows, suspicious, too_complex,
    edge_case (booleans but for asserts, a count)."""
    bonus = F.when(F.col("asserts") > 0, F.least(F.col("asserts") * 6, F.lit(25))).otherwise(-35)
    effects = {"documented": (8, 6), "mocks": (8, 8), "trivial": (-20, -30), "swallows": (-30, -30), "suspicious": (-12, -15), "too_complex": (-10, -10), "edge_case": (6, 4)}
    total = lambda k: F.greatest(F.lit(0), F.least(F.lit(100), 50 + bonus + sum((F.when(F.col(c), v[k]).otherwise(0) for c, v in effects.items()), F.lit(0))))
    out = tests.withColumns({"quality": total(0), "signal": total(1)})
    band = F.when(F.col("signal") >= 70, "high").when(F.col("signal") >= 40, "medium").otherwise("low")
    return out.withColumns({"band": band, "noise": F.col("signal") < 30})
