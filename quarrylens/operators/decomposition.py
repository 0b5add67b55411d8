"""Functional blocks: fingerprints, categories' facts, clusters' advice (X16-X18,
A20-A22, C15-C18, C26, P2, P6-P8, P12, T6, M21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import values as V
from ..functions import scalar as S
from . import joins as J
from .aggregates import mapped

# Words in names that tell an operation, in order.
OPERATIONS = (("read", "read|get|load|fetch|find"), ("write", "write|set|save|store|update"), ("validate", "valid|check|verify|ensure"), ("transform", "parse|convert|format|transform|normal"), ("compute", "calc|comput|count|sum|score"), ("create", "create|build|make|generate"), ("remove", "delete|remove|clear|drop"))
# Categories of imports by their first name.
IMPORTS = {"logging": "logging", "json": "serialization", "pickle": "serialization", "yaml": "serialization", "csv": "serialization", "re": "text", "string": "text", "os": "filesystem", "pathlib": "filesystem", "shutil": "filesystem", "io": "filesystem", "requests": "networking", "urllib": "networking", "socket": "networking", "http": "networking", "sqlite3": "database", "threading": "concurrency", "asyncio": "concurrency", "multiprocessing": "concurrency", "datetime": "time", "time": "time", "math": "math", "random": "math", "statistics": "math"}


def semantic_fingerprint(lines: Column, category: Column, calls: Column, imports: Column) -> Column:
    """Digest of bucketed features: size in fives, category, sorted import
    categories, number of calls in threes (X17)."""
    table = F.create_map(*(F.lit(x) for kv in IMPORTS.items() for x in kv))
    kinds = F.sort_array(F.array_distinct(F.transform(imports, lambda i: F.coalesce(F.element_at(table, F.substring_index(i, ".", 1)), F.lit("other")))))
    return F.sha2(F.concat_ws("|", (F.floor(lines / 5) * 5).cast("string"), category, F.array_join(kinds, ","), (F.floor(F.size(calls) / 3) * 3).cast("string")), 256)


def used_imports(imports: Column, calls: Column) -> Column:
    """Imports that a block's calls speak of: a call begins with the import's
    name or its last part, or ends with it (X18)."""

    def speaks(i):
        last = F.substring_index(i, ".", -1)
        return F.exists(calls, lambda c: c.startswith(F.concat(i, F.lit("."))) | c.startswith(F.concat(last, F.lit("."))) | (c == last) | (c == i) | c.endswith(F.concat(F.lit("."), last)))

    return F.filter(imports, speaks)


def normalised_calls(calls: DataFrame, aliases: DataFrame) -> DataFrame:
    """Calls with their first name replaced by what the file imports under it
    (X16). calls: file_path, target_external; aliases: file_path, alias, target."""
    head = F.substring_index("target_external", ".", 1)
    rest = F.substring(F.col("target_external"), F.length(head) + 1, F.length("target_external"))
    one = aliases.groupBy("file_path", "alias").agg(F.max("target").alias("target"))
    out = calls.withColumn("alias", head).join(one, ["file_path", "alias"], "left")
    return out.withColumn("full_name", F.when(F.col("target").isNotNull(), F.concat("target", rest)).otherwise(F.col("target_external"))).drop("alias", "target")


def operations(name: Column, category: Column, markers: Column, effects: Column, signature: Column | None = None) -> Column:
    """Operations of a method in order, each once (C15, P5): as its signature
    writes them between arrows; without one, those that its category, markers, side
    effects and name tell; none told: unknown."""
    low = F.lower(name)
    some = lambda words: sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0)) > 0
    none = F.array().cast("array<string>")
    word = lambda hit, *o: F.when(hit, F.array(*map(F.lit, o))).otherwise(none)
    told = [word(F.coalesce(category == k, F.lit(False)), *v) for k, v in V.CATEGORY_OPERATIONS.items()]
    told.append(F.array_compact(F.transform(F.coalesce(markers, none), lambda m: mapped(V.MARKER_OPERATIONS, m))))
    told += [word(F.array_contains(F.coalesce(effects, none), k), *v) for k, v in V.EFFECT_OPERATIONS.items()]
    told.append(F.when(low.contains("check"), F.array(F.lit("check"))).when(low.contains("validate"), F.array(F.lit("validate"))).otherwise(none))
    told += [word(some(words), o) for words, o in V.NAME_OPERATIONS]
    inferred = F.array_distinct(F.concat(*told))
    inferred = F.when(F.size(inferred) > 0, inferred).otherwise(F.array(F.lit("unknown")))
    if signature is None:
        return inferred
    written = F.filter(F.transform(F.split(signature, "->"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.when(F.coalesce(signature, F.lit("")) != "", written).otherwise(inferred)


def pattern(ops: Column) -> Column:
    """Pattern of a sequence of operations, the first that fits."""
    has = lambda *o: sum((F.when(F.array_contains(ops, x), 1).otherwise(0) for x in o), F.lit(0)) == len(o)
    text = F.array_join(ops, "->")
    return (
        F.when(has("load", "validate", "save"), "load_validate_save")
        .when(has("fetch", "process", "store"), "fetch_process_store")
        .when(has("check", "execute") & (text.contains("notify") | text.contains("send")), "check_execute_notify")
        .when(has("parse", "transform", "format"), "parse_transform_format")
        .when(has("authenticate", "authorize", "execute"), "authenticate_authorize_execute")
        .when(F.size(F.filter(ops, lambda o: o.isin("acquire", "lock", "release", "unlock"))) >= 2, "acquire_process_release")
        .when((has("validate") | has("check")) & (has("transform") | has("process")), "validate_transform_return")
        .otherwise("unknown")
    )


def merge_strategy(match: Column, score: Column) -> Column:
    """Advice for a match by its type and score (C17)."""
    by = lambda k: mapped({t: v[k] for t, v in V.MERGE_ADVICE.items()}, match)
    return F.when(score >= 0.9, by(0)).when(score >= 0.8, by(1)).when(score >= 0.7, V.MERGE_REST[0]).otherwise(V.MERGE_REST[1])


def similar_symbols(pairs: DataFrame, k: int) -> DataFrame:
    """Symbols most like each other (C18): 1.0 for the same text, 0.9 for the same
    shape, else .3 for the same category, .2 for like complexity, .2 where a word of
    the one's name stands in the other's. Scored, then ranked, then cut (H7).
    a_/b_: token, ast, category, complexity, name."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    same = lambda c: F.coalesce((a(c) != "") & (a(c) == b(c)), F.lit(False))
    alike = (a("complexity") > 0) & (b("complexity") > 0) & (F.least(a("complexity"), b("complexity")) / F.greatest(a("complexity"), b("complexity")) > 0.8)
    names = (a("name") != "") & (b("name") != "") & F.exists(F.split(F.lower(a("name")), "_"), lambda w: F.lower(b("name")).contains(w))
    soft = F.when(same("category"), 0.3).otherwise(0.0) + F.when(alike, 0.2).otherwise(0.0) + F.when(names, 0.2).otherwise(0.0)
    score = F.when(same("token"), 1.0).when(same("ast"), 0.9).otherwise(soft)
    from .aggregates import first_per_group

    return first_per_group(pairs.withColumn("similarity", score), ["a"], [F.desc("similarity"), F.col("b")], k)


def name_guards(members: DataFrame, cluster: str, name: str) -> DataFrame:
    """What the names of a cluster forbid (P6), plain substrings of lower-cased
    names: dunder (a special method), modal (predicates among others), opposite
    (antonyms, variants among others, a name and its negation), and the mean
    likeness of all pairs of names."""
    low = F.lower(name)
    either = lambda flags: F.array_contains(F.array(*flags), True)
    mix = lambda hit: F.bool_or(hit) & F.bool_or(~hit)
    modal = either([mix(low.startswith(p)) for p in V.MODAL_PREFIXES])
    opposite = either([F.bool_or(low.contains(a)) & F.bool_or(low.contains(b)) for a, b in V.ANTONYMS] + [mix(low.contains(v)) for v in V.VARIANTS])
    names = F.collect_list(low)
    out = members.groupBy(cluster).agg(F.bool_or(F.col(name).startswith("__") & F.col(name).endswith("__")).alias("dunder"), modal.alias("modal"), opposite.alias("opposite"), names.alias("_names"))
    plain = lambda old, new: F.exists("_names", lambda n: n.contains(old) & F.array_contains("_names", F.replace(n, F.lit(old), F.lit(new))))
    opposite = F.col("opposite") | F.col("modal") | plain("_no_", "_") | plain("_strict", "")
    return out.select(cluster, "dunder", "modal", opposite.alias("opposite"), S.mean_name_ratio("_names").alias("name_similarity"))


def risk(mean: Column, callers: Column, most_complex: Column) -> Column:
    """Risk of a cluster."""
    return F.when(mean < 0.6, "HIGH").when((callers > 10) | (most_complex > 15), "MEDIUM").otherwise("LOW")


def effort(advice: Column, members: Column, lines: Column) -> Column:
    """Effort class of a cluster by what is to be done with it."""
    merge = F.when((members <= 2) & (lines <= 50), "S").when((members <= 4) & (lines <= 100), "M").otherwise("L")
    return F.when(advice == "KEEP_SEPARATE", "XS").when(advice == "WRAP_ONLY", "S").when(advice == "MERGE", merge).otherwise(F.when(lines <= 100, "M").otherwise("L"))


def benefit(members: Column, mean: Column, advice: Column, risk: Column, effort: Column) -> Column:
    """Benefit of a cluster: its size, similarity, and what advice, risk and
    effort add (A22)."""
    more = lambda table, key: F.coalesce(mapped(table, key), F.lit(0.0))
    return members * 2.0 + mean * 10.0 + more(V.RECOMMENDATION_BENEFIT, advice) + more(V.RISK_BENEFIT, risk) + more(V.EFFORT_BENEFIT, effort)


def plan_order(risk: Column, effort: Column, dependencies: Column) -> list[Column]:
    """Order of plans: low risk, low effort, few dependencies first."""
    return [F.coalesce(mapped(V.RISK_ORDER, risk), F.lit(2)), F.coalesce(mapped(V.EFFORT_ORDER, effort), F.lit(4)), dependencies]


def cluster_report(clusters: DataFrame) -> DataFrame:
    """Clusters, their members and total benefit by risk and effort."""
    return clusters.groupBy("risk", "effort").agg(F.count("*").alias("n_clusters"), F.sum("members").alias("n_members"), F.sum("benefit").alias("benefit"))


def target_name(category: Column, subcategory: Column, canonical: Column) -> Column:
    """Module and function proposed for a cluster, by its canonical member."""
    module = F.coalesce(mapped(V.TARGET_MODULES, category), F.concat(F.lit("unified/"), category, F.lit(".py")))
    base = F.replace(F.regexp_replace(canonical, "^_+", ""), F.lit("__"), F.lit("_"))
    full = F.when((F.coalesce(subcategory, F.lit("")) != "") & (subcategory != "generic") & ~canonical.startswith("_"), F.concat(subcategory, F.lit("_"), base)).otherwise(base)
    return F.concat(module, F.lit("::"), full)


def call_class(name: Column, standard: tuple[str, ...], builtins: tuple[str, ...]) -> Column:
    """Kind of an unresolved call."""
    head = F.substring_index(name, ".", 1)
    return F.when(name.isin(*builtins), "builtin").when(head.isin(*standard), "standard").when(head.isin("self", "cls", "super"), "dynamic_attribute").when(name.contains("."), "external").otherwise("unknown")


def resolution_rates(calls: DataFrame) -> DataFrame:
    """Shares of calls resolved, of internal ones, and of those not builtin.
    calls: target_uid, call_class."""
    known = F.col("target_uid").isNotNull()
    inside = known | F.col("call_class").isin("unknown", "dynamic_attribute")
    plain = F.col("call_class") != "builtin"
    ratio = lambda a, b: F.when(F.count_if(b) > 0, F.count_if(a & b) / F.count_if(b)).otherwise(0.0)
    return calls.agg(ratio(known, F.lit(True)).alias("resolved"), ratio(known, inside).alias("resolved_internal"), ratio(known, plain).alias("resolved_without_builtins"))


def capabilities(blocks: DataFrame, least: int = 2) -> DataFrame:
    """Categories of ``least`` blocks or more, with their owner and modules."""
    from .aggregates import owner

    by = ["category", "subcategory"]
    out = owner(blocks, by, "module", least)
    return out.join(blocks.groupBy(*by).agg(F.count_distinct("module").alias("n_modules")), by)


def strategy_text(duties: DataFrame, cls: str) -> DataFrame:
    """How to take a class apart, by its duties."""
    return duties.groupBy(cls).agg(F.concat(F.lit("split by "), F.array_join(F.sort_array(F.collect_set("duty")), ", ")).alias("strategy"))


def file_issues(df: DataFrame, large: int = 500, complexity: int = 15, deep: int = 3, many: int = 10) -> DataFrame:
    """Issues of a file, its priority from 1 to 10, and how far a machine can help
    (M21): lines, complexity, god_objects (how many), complex_items, most_duties,
    nested_depth, nested_definitions."""
    c = F.col
    rules = (
        F.when(c("lines") > large * 2, "very large file").when(c("lines") > large, "large file"),
        F.when(c("complexity") > complexity * 20, "critical complexity").when(c("complexity") > complexity * 10, "high complexity"),
        F.when(c("complex_items") > 0, "complex methods"), F.when(c("nested_depth") >= deep, "deep nesting"), F.when(c("nested_definitions") > many, "many nested definitions"),
    )
    gods = F.expr("array_repeat('god object', CAST(god_objects AS INT))")
    out = df.withColumn("issues", F.concat(F.array_compact(F.array(*rules[:2])), gods, F.array_compact(F.array(*rules[2:]))))
    size = F.when(c("lines") > large * 4, 4).when(c("lines") > large * 2, 3).when(c("lines") > large, 2).otherwise(0)
    score = 1 + size + F.least(c("god_objects") * 2, F.lit(4)) + F.least(F.size("issues"), F.lit(3)) + F.when(c("nested_depth") >= deep, 1).otherwise(0)
    text = F.array_join("issues", " ")
    help_ = F.when(c("god_objects") > 0, 4).otherwise(0) + F.when(text.contains("large file"), 3).otherwise(0) + F.when(text.contains("complex"), 2).otherwise(0) + F.when(c("most_duties") > 3, 2).otherwise(0)
    return out.withColumns({"priority": F.least(score, F.lit(10)), "automation": F.least(help_, F.lit(10)) / 10})


def unresolved_reason(name: Column, candidates: Column, has_receiver_type: Column) -> Column:
    """Why a call has no target (J22), the first that fits."""
    head = F.substring_index(name, ".", 1)
    return (
        F.when(name.isNull() | (name == ""), "no_name")
        .when(candidates > 1, "ambiguous")
        .when(head == "self", "no_such_method")
        .when(head == "super", "inherited")
        .when(name.contains("[") | name.contains("("), "computed")
        .when(name.contains(".") & ~has_receiver_type, "unknown_receiver")
        .when(name.contains("."), "external")
        .otherwise("not_found")
    )


def calls_between(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Plans that depend on each other through calls (G12). clusters: cluster,
    block; edges: caller, callee."""
    from .graph import condensed

    return condensed(edges, clusters, "block", "cluster", "caller", "callee")


def imports_by_candidates(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Files that import each file, by its path or its module name (P14, P22,
    J28): the first kind of name that finds any. files: file_path, module."""
    by = imports.select(F.col("target").alias("name"), F.col("file_path").alias("importer")).distinct()
    tries = files.select("file_path", F.explode(F.array(F.struct(F.lit(0).alias("p"), F.col("module").alias("name")), F.struct(F.lit(1).alias("p"), F.substring_index("module", ".", -1).alias("name")))).alias("t")).select("file_path", "t.*")
    found = tries.join(by, "name").where("importer != file_path").groupBy("file_path", "p").agg(F.sort_array(F.collect_set("importer")).alias("importers"))
    best = found.groupBy("file_path").agg(F.min_by("importers", "p").alias("importers"))
    return J.occurrence(files.join(best, "file_path", "left"), ["file_path"], ["module"]).where("occurrence = 0").drop("occurrence")


def resolved_calls(calls: DataFrame, blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """Targets of calls by the first rule that decides, which may decide that there
    is none (J22). All rules are joins on keys of the blocks; each key has one row.

    calls: call, module, file_path, class_name (null outside classes), raw (as
    written), full (with imports resolved), receiver (class that the receiver is
    known to be, as imports resolve it; null if not known), receiver_external,
    external, dynamic, star_import (booleans), local_defs, inputs, assigned (arrays
    of names). blocks: block, module, file_path, class_name, name, qualified_name.
    classes: module, class_name, of all classes defined anywhere.

    Adds target (null if none) and how: the rule, or the reason for none."""
    c = F.col
    method = blocks.where("class_name IS NOT NULL").groupBy("module", "class_name", "name").agg(F.max("block").alias("t"))
    init = method.where("name = '__init__'").select("module", "class_name", c("t").alias("init"))
    known = method.select("module", "class_name").distinct().join(init, ["module", "class_name"], "left").withColumn("has", F.lit(True))
    defined = classes.select("module", "class_name").distinct().withColumn("defined", F.lit(True))
    anywhere = defined.select("class_name").distinct().withColumn("defined_anywhere", F.lit(True))

    def one(keys: dict[str, Column], name: str) -> DataFrame:
        """The only block of a key, by the key's names: <name>; and how many there are: <name>_n."""
        return blocks.groupBy(*(v.alias(k) for k, v in keys.items())).agg(F.min("block").alias(name), F.count("*").alias(f"{name}_n"))

    tail, head = F.substring_index("full", ".", -1), F.substring_index("raw", ".", 1)
    dotted_full, dotted = c("full").contains("."), c("raw").contains(".")
    upper = lambda x: F.regexp_replace(x, "^_+", "").rlike("^\\p{Lu}")
    before = lambda x: F.regexp_extract(x, r"^(.*)\.[^.]+$", 1)
    of_class = F.substring_index("receiver", ".", -1)
    out = calls.withColumns({
        "_tail": tail, "_owner": before(c("full")), "_own": F.when(c("raw").startswith("self."), F.substring("raw", 6, 10**6)).when(c("raw").startswith("cls."), F.substring("raw", 5, 10**6)),
        "_head": head, "_rest": F.substring(c("raw"), F.length(head) + 2, F.length("raw")), "_last": F.substring_index("raw", ".", -1),
        "_rmod": F.when(c("receiver").contains("."), before(c("receiver"))).otherwise(c("module")), "_rcls": of_class,
    })

    def joined(df, right, keys):
        return df.join(right, list(keys), "left")

    cls = lambda df, m, k, p: df.select(c("module").alias(m), c("class_name").alias(k), *(c(x).alias(f"{p}_{x}") for x in df.columns if x not in ("module", "class_name")))
    out = joined(out, cls(known, "module", "raw", "same"), ("module", "raw"))
    out = joined(out, cls(defined, "module", "raw", "same"), ("module", "raw"))
    out = joined(out, cls(known, "_owner", "_tail", "far"), ("_owner", "_tail"))
    out = joined(out, cls(defined, "_owner", "_tail", "far"), ("_owner", "_tail"))
    out = joined(out, anywhere.withColumnRenamed("class_name", "raw"), ("raw",))
    out = joined(out, cls(known, "module", "class_name", "own"), ("module", "class_name"))
    out = joined(out, cls(known, "_rmod", "_rcls", "type"), ("_rmod", "_rcls"))
    qualified = {"full": c("qualified_name")}
    for name, more in (("q", {}), ("qm", {"module": c("module")}), ("qf", {"file_path": c("file_path")})):
        out = joined(out, one(qualified | more, name), (qualified | more).keys())
    out = joined(out, one({"_owner": c("module"), "_tail": c("name")}, "f"), ("_owner", "_tail"))
    for name, more in (("n", {}), ("nm", {"module": c("module")}), ("nf", {"module": c("module"), "file_path": c("file_path")})):
        out = joined(out, one({"_tail": c("name")} | more, name), ("_tail", *more))
    met = lambda m, k, n, name: method.select(c("module").alias(m), c("class_name").alias(k), c("name").alias(n), c("t").alias(name))
    out = joined(out, met("module", "class_name", "_own", "own_method"), ("module", "class_name", "_own"))
    out = joined(out, met("module", "_head", "_rest", "class_method"), ("module", "_head", "_rest"))
    out = joined(out, met("_rmod", "_rcls", "_last", "typed"), ("_rmod", "_rcls", "_last"))
    elsewhere = method.groupBy("class_name").agg(F.min("module").alias("_first")).withColumnRenamed("class_name", "_rcls")
    out = joined(out, elsewhere, ("_rcls",)).join(met("_first", "_rcls", "_last", "typed_else"), ["_first", "_rcls", "_last"], "left")
    # module.Class.method at the shortest module that has it
    parts = F.split("full", r"\.")
    cuts = out.where(F.size(parts) > 2).select("call", F.slice(parts, F.size(parts) - 1, 2).alias("_e"), parts.alias("_p"), F.explode(F.sequence(F.lit(1), F.size(parts) - 2)).alias("_i"))
    cuts = cuts.select("call", "_i", F.array_join(F.slice("_p", 1, c("_i")), ".").alias("module"), c("_e")[0].alias("class_name"), c("_e")[1].alias("name"))
    deep = cuts.join(method, ["module", "class_name", "name"]).groupBy("call").agg(F.min_by("t", "_i").alias("deep"))
    out = joined(out, deep, ("call",))

    true = lambda x: F.coalesce(x, F.lit(False))
    in_class, plain = c("class_name").isNotNull(), ~dotted
    none = F.lit(None).cast(blocks.schema["block"].dataType)
    maker = plain & upper(c("raw"))
    unique = lambda name: F.when(c(f"{name}_n") == 1, c(name))
    here = lambda base: F.coalesce(unique(base), unique(f"{base}m"), unique(f"{base}f"))
    typed = c("receiver").isNotNull() & dotted
    callback = c("raw").isin("func", "processor_func", "progress_callback") | c("raw").rlike("(_callback|_cb|_func)$") | true(F.array_contains("inputs", c("raw")))
    late = (true(F.array_contains("assigned", c("raw"))) & c("n_n").isNull()) | (c("raw") == "callback") | c("raw").rlike("(_callback|_cb|_func|_factory|_builder|_class)$")
    rules = (
        (maker & dotted_full & c("external"), none, "external"),
        (maker & true(c("same_has")), c("same_init"), F.when(c("same_init").isNull(), "class_instantiation").otherwise("constructor_same_module")),
        (maker & true(c("same_defined")), none, "class_instantiation"),
        (maker & dotted_full & true(c("far_has")), c("far_init"), F.when(c("far_init").isNull(), "class_instantiation").otherwise("constructor_imported")),
        (maker & dotted_full & true(c("far_defined")), none, "class_instantiation"),
        (maker & (true(c("defined_anywhere")) | dotted_full), none, "class_instantiation"),
        (here("q").isNotNull(), here("q"), "exact_qualname"),
        (dotted_full & c("deep").isNotNull(), c("deep"), "symbol_table"),
        (dotted_full & unique("f").isNotNull(), unique("f"), "symbol_table"),
        (c("_own").isNotNull() & in_class & c("own_method").isNotNull(), c("own_method"), "same_module"),
        (c("_own").isNotNull() & in_class & ~c("_own").contains("."), none, "baseclass_method"),
        (c("raw").startswith("super.") | c("raw").startswith("super()"), none, "baseclass_method"),
        ((c("raw") == "cls") & in_class, c("own_init"), F.when(c("own_init").isNull(), "class_instantiation").otherwise("constructor_same_module")),
        (dotted & c("_head").rlike("^\\p{Lu}") & ~c("_rest").contains(".") & c("class_method").isNotNull(), c("class_method"), "class_method_same_module"),
        (typed & c("receiver_external"), none, "external"),
        (typed & c("typed").isNotNull(), c("typed"), "local_type_hint"),
        (typed & true(c("type_has")), none, "baseclass_method"),
        (typed & c("typed_else").isNotNull(), c("typed_else"), "local_type_hint"),
        (typed, none, "baseclass_method"),
        (c("nm_n") == 1, c("nm"), "same_module"),
        ((c("nm_n") > 1) & (c("nf_n") == 1), c("nf"), "same_module"),
        ((c("n_n") == 1) & ~c("external"), c("n"), "method_name"),
        (c("star_import") & plain, none, "star_import"),
        (c("external"), none, "external"),
        (c("dynamic"), none, "dynamic_attribute"),
        (c("n_n") > 1, none, "ambiguous"),
        (plain & true(F.array_contains("local_defs", c("raw"))), none, "nested_local"),
        (plain & callback, none, "dynamic_callback"),
        (plain & upper(c("raw")), none, "class_instantiation"),
        (plain & late, none, "dynamic_callback"),
    )
    chosen = F.when(F.lit(False), F.struct(none.alias("t"), F.lit("").alias("h")))
    for when, target, how in rules:
        chosen = chosen.when(F.coalesce(when, F.lit(False)), F.struct(target.alias("t"), (F.lit(how) if isinstance(how, str) else how).alias("h")))
    chosen = chosen.otherwise(F.struct(none.alias("t"), F.lit("not_found").alias("h")))
    return out.withColumn("_c", chosen).select(*calls.columns, c("_c.t").alias("target"), c("_c.h").alias("how"))
