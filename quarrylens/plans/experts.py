"""Expert analyses over the facts of one project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import joins as J
from ..operators import rules as R
from ..sources import extract
from .audit import Audit


def internal_calls(a: Audit) -> DataFrame:
    """caller, callee (uids) of calls within one file (E1): self and cls calls by
    method name, plain calls by name, where the name is unique in the file."""
    own = J.unique_names(a.symbols.where("kind IN ('function', 'method')"), ["file_path", "name"], "symbol_uid").select("file_path", "name", F.col("symbol_uid").alias("callee"))
    plain = F.regexp_replace("target_external", "^(self|cls)[.]", "")
    calls = a.dependencies.where("dependency_kind = 'calls'").select("file_path", F.col("source_uid").alias("caller"), plain.alias("name"), "line").where("name NOT LIKE '%.%'")
    return calls.join(own, ["file_path", "name"])


def call_graph(a: Audit) -> DataFrame:
    """Fan-in, fan-out, callees and callers by method (A23, P29); cohesion is one
    if any call is internal (H14)."""
    edges = internal_calls(a)
    out = G.degrees(edges, "caller", "callee").join(G.calls_of(edges, "caller", "callee"), "node")
    return out.withColumn("cohesion_score", F.when(F.col("fan_in") + F.col("fan_out") > 0, 1.0).otherwise(0.0))


def callers(a: Audit, path: str) -> DataFrame:
    """Who outside uses a file's symbols (E2, P30, A24): file, symbol, uses."""
    mine = a.symbols.where(F.col("file_path") == path).select(F.col("symbol_uid").alias("target_uid"), F.col("qualified_name").alias("symbol"))
    return extract.resolved(a.dependencies, a.symbols).join(mine, "target_uid").where(F.col("file_path") != path).groupBy("file_path", "symbol").agg(F.count("*").alias("uses"))


def contracts(details: DataFrame) -> DataFrame:
    """Behaviour that docstrings state and code implies (E3): symbol, contract, text."""
    doc = details.where("detail = 'doc'").select("symbol_uid", F.explode(F.regexp_extract_all("value", F.lit(r"(?im)^[ \t]*(?:raises?|returns?|args?|requires?|ensures?|note)s?:?.*$"), F.lit(0))).alias("text"))
    doc = doc.select("symbol_uid", F.lower(F.regexp_extract("text", r"(?i)(raise|return|arg|require|ensure|note)", 1)).alias("contract"), F.trim("text").alias("text"))
    code = details.where("detail IN ('assert', 'raise')").select("symbol_uid", F.when(F.col("detail") == "assert", "precondition").otherwise("raise").alias("contract"), F.col("value").alias("text"))
    return doc.unionByName(code)


def imports_classified(a: Audit, standard: tuple[str, ...]) -> DataFrame:
    """Imports as internal, standard or third-party, with their use in the file
    (E4, P21): none is unused, over five is critical."""
    inside = a.symbols.where("kind = 'module'").select(F.substring_index("qualified_name", ".", 1).alias("top")).distinct().withColumn("internal", F.lit(True))
    top = F.substring_index("target_external", ".", 1)
    found = a.dependencies.where("dependency_kind = 'imports'").select("file_path", F.col("target_external").alias("module"), top.alias("top"), F.substring_index("target_external", ".", -1).alias("name")).distinct()
    uses = a.dependencies.where("dependency_kind != 'imports'").select("file_path", F.substring_index("target_external", ".", 1).alias("name")).groupBy("file_path", "name").agg(F.count("*").alias("uses"))
    out = found.join(inside, "top", "left").join(uses, ["file_path", "name"], "left").na.fill(0, ["uses"])
    kind = F.when(F.col("internal"), "internal").when(F.col("top").isin(*standard), "standard").otherwise("third_party")
    level = F.when(F.col("uses") == 0, "unused").when(F.col("uses") > 5, "critical").otherwise("normal")
    return out.select("file_path", "module", kind.alias("kind"), "uses", level.alias("level"), F.col("name").startswith("_").alias("private_name"))


def cohesion_matrix(a: Audit) -> DataFrame:
    """Methods by attributes in long form, with each method's share of its class's
    attributes and a band (E5, P28)."""
    methods = a.symbols.where("kind = 'method'").select("symbol_uid", F.col("parent_uid").alias("class_uid"))
    uses = a.accesses.join(methods, "symbol_uid").groupBy("class_uid", "symbol_uid", "attribute_name").agg(F.count("*").alias("n"))
    total = uses.groupBy("class_uid").agg(F.count_distinct("attribute_name").alias("total"))
    touched = uses.groupBy("class_uid", "symbol_uid").agg(F.count("*").alias("touched"))
    share = F.col("touched") / F.col("total")
    band = F.when(share == 0, "none").when(share < 0.25, "low").when(share > 0.7, "high").otherwise("middle")
    return uses.join(touched, ["class_uid", "symbol_uid"]).join(total, "class_uid").withColumn("share", share).withColumn("band", band)


def test_coverage(a: Audit, tests: DataFrame) -> DataFrame:
    """Symbols and whether their name stands anywhere in a test's text, in a longer
    word too (E6, U3, H23): tests has file_path and content."""
    public = a.symbols.where("kind IN ('function', 'method', 'class') AND is_public")
    named = J.named_within(public.select("name"), "name", tests, "content").withColumn("tested", F.lit(True))
    return public.join(named, "name", "left").na.fill(False, ["tested"]).select("symbol_uid", "file_path", "name", "kind", "tested")


def coverage_share(covered: DataFrame, test_file: str, covers: DataFrame) -> DataFrame:
    """Share of the target's symbols that each test file names, and the mean over
    test files as one further row with a null file (A34). covered: all symbols
    (name); covers: test file, name."""
    total = covered.select("name").distinct().count()
    each = covers.join(covered.select("name").distinct(), "name", "left_semi").groupBy(test_file).agg(F.count_distinct("name").alias("n"))
    each = covers.select(test_file).distinct().join(each, test_file, "left").select(test_file, F.when(F.lit(total) > 0, 100.0 * F.coalesce("n", F.lit(0)) / total).otherwise(0.0).alias("percent"))
    return each.unionByName(each.agg(F.lit(None).cast(each.schema[test_file].dataType).alias(test_file), F.avg("percent").alias("percent")))


def characterisation_cases(details: DataFrame) -> DataFrame:
    """Test cases by parameter (E7): a typical call, then one factor at a time an
    edge and an error value by the parameter's type."""
    hints = details.where("detail = 'type_hint'").select("symbol_uid", "name", F.lower("value").alias("hint"))
    given = details.where("detail = 'parameter' AND name NOT IN ('self', 'cls')").select("symbol_uid", "name").distinct().join(hints, ["symbol_uid", "name"], "left")
    kind = F.when(F.col("hint").rlike("int|float"), "number").when(F.col("hint").rlike("str"), "text").when(F.col("hint").rlike("list|dict|set|tuple"), "container").when(F.col("hint").rlike("bool"), "flag").otherwise("any")
    values = {"number": (("edge", "0"), ("edge", "-1"), ("error", "'x'")), "text": (("edge", "''"), ("error", "None")), "container": (("edge", "empty"), ("error", "None")), "flag": (("edge", "False"),), "any": (("error", "None"),)}
    table = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.array(*(F.struct(F.lit(a).alias("case"), F.lit(b).alias("value")) for a, b in v)))))
    one = given.withColumn("c", F.explode(F.element_at(table, kind))).select("symbol_uid", F.col("c.case").alias("case"), F.col("name").alias("parameter"), F.col("c.value").alias("value"))
    typical = given.select("symbol_uid").distinct().select("symbol_uid", F.lit("typical").alias("case"), F.lit(None).cast("string").alias("parameter"), F.lit(None).cast("string").alias("value"))
    return typical.unionByName(one)


def key_usage(details: DataFrame) -> DataFrame:
    """Keys of dictionaries by how they are read (E11, A27, P25): safe reads are
    get and in; a key read often, and unsafely, is critical."""
    k = details.where("detail = 'key'").select("file_path", "name", F.substring_index("value", ":", 1).alias("how"), F.regexp_extract("value", "^[a-z]+:(.*)$", 1).alias("key"))
    out = k.groupBy("file_path", "name", "key").agg(F.count("*").alias("n"), F.count_if(F.col("how") != "index").alias("safe"), F.sort_array(F.collect_set("how")).alias("methods"))
    return out.withColumn("safety", F.col("safe") / F.col("n")).withColumn("critical", (F.col("n") > 5) & (F.col("safe") < F.col("n")))


def exception_contracts(a: Audit, details: DataFrame) -> DataFrame:
    """Exceptions that public functions raise and handle, and their safety."""
    raised = details.where("detail = 'raise'").groupBy("symbol_uid").agg(F.sort_array(F.collect_set("name")).alias("raises"))
    handled = details.where("detail = 'handler'").groupBy("symbol_uid").agg(F.sort_array(F.collect_set(F.coalesce("name", F.lit("any")))).alias("handles"), F.bool_or(F.col("value") == "handled").alias("has_fallback"))
    out = a.symbols.where("kind IN ('function', 'method') AND is_public").select("symbol_uid", "qualified_name").join(raised, "symbol_uid", "left").join(handled, "symbol_uid", "left")
    n = F.coalesce(F.size("raises"), F.lit(0))
    level = F.when(F.col("raises").isNull(), "safe").when(F.coalesce("has_fallback", F.lit(False)), "with_fallback").when(n <= 2, "moderate").otherwise("high_risk")
    return out.withColumn("safety", level)


def propagation(a: Audit) -> DataFrame:
    """Method and the plain or self names it calls."""
    plain = F.regexp_replace("target_external", "^self[.]", "")
    calls = a.dependencies.where("dependency_kind = 'calls'").withColumn("name", plain).where("name NOT LIKE '%.%'")
    return calls.groupBy("source_uid").agg(F.sort_array(F.collect_set("name")).alias("calls"))


def golden_traces(a: Audit) -> DataFrame:
    """Calls of each function in the order of their lines."""
    calls = a.dependencies.where("dependency_kind = 'calls'")
    return calls.groupBy("file_path", "source_uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "target_external"))), lambda x: x["target_external"]).alias("trace"))


def argument_patterns(details: DataFrame, most: int = 5) -> DataFrame:
    """Most frequent values of each callee's parameters (A28), ``most`` each."""
    arg = details.where("detail = 'argument'").select(F.regexp_extract("name", "^(.*):", 1).alias("callee"), F.substring_index("name", ":", -1).alias("parameter"), "value")
    counts = arg.groupBy("callee", "parameter", "value").agg(F.count("*").alias("n"))
    return A.first_per_group(counts, ["callee", "parameter"], [F.desc("n"), F.col("value")], most)


def optional_dependencies(details: DataFrame) -> DataFrame:
    """Optional imports and flags, with a scenario for each state."""
    mods = details.where("detail = 'optional_import'").groupBy(F.col("name")).agg(F.count_distinct("file_path").alias("n_files")).withColumn("kind", F.lit("module"))
    flags = details.where("detail = 'flag'").groupBy("name").agg(F.count_distinct("file_path").alias("n_files")).withColumn("kind", F.lit("flag"))
    return mods.unionByName(flags).withColumn("scenario", F.explode(F.when(F.col("kind") == "module", F.array(F.lit("available"), F.lit("unavailable"))).otherwise(F.array(F.lit("on"), F.lit("off")))))


def test_quality(a: Audit, details: DataFrame) -> DataFrame:
    """Quality and signal of each test function (E15, A33, P26): what it asserts,
    mocks, swallows, and names as an edge case."""
    tests = a.symbols.where("kind IN ('function', 'method') AND name LIKE 'test\\\\_%'").select("symbol_uid", "file_path", "qualified_name", "name", (F.col("complexity_score") > 6).alias("too_complex"))
    value, kind = F.col("value"), F.col("detail")
    trivial = (kind == "assert") & (value.isin("True", "1") | value.rlike(r"assertTrue\(True"))
    odd = (kind == "argument") & F.substring_index("name", ":", -1).isin("node", "project_path", "progress_callback") & value.isin("None", "0", "''", "[]", "{}")
    words = lambda x: sum((F.when(F.lower(x).contains(w), 1).otherwise(0) for w in V.EDGE_WORDS), F.lit(0)) > 0
    facts = details.groupBy("symbol_uid").agg(
        F.count_if(kind == "assert").alias("asserts"), F.count_if(kind == "doc").alias("docs"), F.count_if(kind == "mock").alias("n_mocks"), F.count_if(trivial).alias("n_trivial"),
        F.count_if((kind == "handler") & (value == "pass")).alias("n_swallows"), F.count_if(odd).alias("n_odd"), F.count_if((kind == "doc") & words("value")).alias("n_edge"),
    )
    out = tests.join(facts, "symbol_uid", "left").na.fill(0)
    some = {"documented": "docs", "mocks": "n_mocks", "trivial": "n_trivial", "swallows": "n_swallows", "suspicious": "n_odd"}
    out = out.withColumns({k: F.col(c) > 0 for k, c in some.items()}).withColumn("edge_case", (F.col("n_edge") > 0) | words("name"))
    return R.test_signal(out).drop("docs", "n_mocks", "n_trivial", "n_swallows", "n_odd", "n_edge")


def compatibility(a: Audit, old: Audit) -> DataFrame:
    """Public names removed or with a new signature, and how many files import
    them (E10, U2, M23, P20)."""
    key = ["file_path", "qualified_name"]
    was, now = (x.symbols.where("is_public").groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("signature")), " | ").alias("signature")) for x in (old, a))
    gone = was.join(now, key, "left_anti").withColumn("change", F.lit("removed"))
    moved = was.join(now.withColumnRenamed("signature", "new"), key).where("signature != new").drop("new").withColumn("change", F.lit("signature"))
    changed = gone.unionByName(moved).withColumn("module", F.regexp_extract("qualified_name", "^(.*)[.][^.]+$", 1))
    users = a.dependencies.where("dependency_kind = 'imports'").select(F.col("target_external").alias("module"), "file_path").distinct()
    names = users.unionByName(users.select(F.regexp_extract("module", "^(.*)[.][^.]+$", 1).alias("module"), "file_path")).distinct().groupBy("module").agg(F.count("*").alias("n_files"))
    return changed.join(names, "module", "left").na.fill(0, ["n_files"]).withColumn("risk", R.change_risk(F.col("n_files"))).drop("module")


def workflow(a: Audit) -> DataFrame:
    """Position of every call in its file."""
    return a.dependencies.where("dependency_kind = 'calls'").withColumn("position", F.row_number().over(Window.partitionBy("file_path").orderBy("line", "target_external", "source_uid")))
