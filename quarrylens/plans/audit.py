"""The audit plan: sources, facts, findings, statistics, decisions, dashboards.

Every step is lazy; ``run`` writes the facts once, since all else reads them.
"""

from __future__ import annotations

import builtins
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import joins as J
from ..operators import rules as R
from ..operators import similarity as C
from ..sources import code, extract

BUILTINS = tuple(n for n in dir(builtins) if not n.startswith("_"))


@dataclass
class Audit:
    """Frames of one audit."""

    files: DataFrame
    symbols: DataFrame
    blocks: DataFrame
    dependencies: DataFrame
    accesses: DataFrame
    errors: DataFrame


def facts(spark: SparkSession, root: str, target: str) -> Audit:
    """Scan and extract once; the tagged facts are written below ``target``."""
    scan = code.files(spark, root)
    scan.select(F.xxhash64("file_path").alias("file_id"), "file_path", "content_hash", "file_size", "lines_of_code", "is_test_file").write.mode("overwrite").parquet(f"{target}/files")
    extract.facts(scan).write.mode("overwrite").partitionBy("table").parquet(f"{target}/facts")
    tagged = spark.read.parquet(f"{target}/facts")
    t = {n: extract.table_of(tagged, n) for n in schemas.ALL if n != "files"}
    return Audit(spark.read.parquet(f"{target}/files"), t["symbols"], t["blocks"], t["dependencies"], t["attribute_access"], t["errors"])


def class_metrics(a: Audit) -> DataFrame:
    """Methods, responsibilities, cohesion, foreign and private accesses, external
    dependencies and lines of each class (P1, M8, M9). Cohesion is over attributes
    that the class assigns; without any it is 1."""
    methods = a.symbols.where("kind = 'method'").select("symbol_uid", F.col("parent_uid").alias("class_uid"), "name", R.responsibility(F.col("name"))[0].alias("duty"))
    counts = methods.groupBy("class_uid").agg(F.count("*").alias("method_count"), F.count_distinct("duty").alias("responsibility_count"))
    access = methods.join(a.accesses, "symbol_uid")
    mine = F.coalesce(F.col("receiver") == "self", F.lit(False))
    hidden = F.col("attribute_name").startswith("_") & ~F.col("attribute_name").startswith("__")
    foreign = access.where(~mine).groupBy("class_uid").agg(F.count("*").alias("foreign_accesses"), F.count_if(hidden).alias("private_accesses"))
    owned = access.where(mine & (F.col("access_type") == "write")).select("class_uid", "attribute_name").distinct()
    touched = access.where(mine).join(owned, ["class_uid", "attribute_name"], "left_semi").select("symbol_uid", "attribute_name")
    held = methods.join(owned.select("class_uid").distinct(), "class_uid", "left_semi").join(touched, "symbol_uid", "left")
    held = R.cohesion(held, "class_uid", "symbol_uid", "attribute_name").select("class_uid", "cohesion")
    calls = a.dependencies.where("dependency_kind = 'calls'").join(methods.select(F.col("symbol_uid").alias("source_uid"), "class_uid"), "source_uid")
    plain = ~F.col("target_external").contains(".")
    outside = F.when(plain, ~F.col("target_external").startswith("_") & ~F.col("target_external").isin(*BUILTINS)).otherwise(~F.substring_index("target_external", ".", 1).isin("self", "cls"))
    deps = calls.where(outside).groupBy("class_uid").agg(F.count_distinct(F.substring_index("target_external", ".", -1)).alias("external_dependencies"))
    out = a.symbols.where("kind = 'class'").select(F.col("symbol_uid").alias("class_uid"), "file_path", "qualified_name", F.col("lines_of_code").alias("lines"), "line_start", "line_end")
    for x in (counts, foreign, held, deps):
        out = out.join(x, "class_uid", "left")
    return out.na.fill(0, ["method_count", "responsibility_count", "foreign_accesses", "private_accesses", "external_dependencies"]).na.fill(1.0, ["cohesion"])


def method_metrics(a: Audit) -> DataFrame:
    """What the method rules need (M3, M4, M6, P1): chains of attributes count once."""
    mine = F.coalesce(F.col("root") == "self", F.lit(False))
    uses = a.accesses.where("outermost").groupBy("symbol_uid").agg(F.count("*").alias("accesses"), F.count_if(~mine).alias("external_accesses"))
    out = a.symbols.where("kind IN ('method', 'function')").select(
        "symbol_uid", "file_path", "qualified_name", F.col("lines_of_code").alias("lines"), F.col("statement_count").alias("statements"), F.col("smell_complexity").alias("complexity"),
        F.col("nesting_depth").alias("nesting"), (F.col("kind") == "method").alias("in_class"), "line_start", "line_end",
    )
    return out.join(uses, "symbol_uid", "left").na.fill(0)


def findings(a: Audit) -> DataFrame:
    """Findings of all rules in one table, the smell type as a column of its own."""
    where = ["file_path", "line_start", "line_end"]
    row = [*where, F.col("qualified_name").alias("target"), "smell_type", "severity", "confidence"]
    classes = class_metrics(a)
    god = R.god_class(classes).select(*row).unionByName(R.class_smells(classes).select(*row))
    smells = R.method_smells(method_metrics(a)).select(*row)
    dead = unused(a).select(*where, F.col("qualified_name").alias("target"), F.lit("unused").alias("smell_type"), "severity", "confidence")
    members = clones(a).select("clone_type", F.col("similarity").alias("confidence"), F.explode("members").alias("block_uid")).join(a.blocks, "block_uid")
    twins = members.select(*where, F.col("block_uid").alias("target"), F.concat(F.lit("clone_"), "clone_type").alias("smell_type"), F.lit("medium").alias("severity"), "confidence")
    out = god.unionByName(smells).unionByName(dead).unionByName(twins)
    kind = F.when(F.col("smell_type") == "unused", "unused_code").when(F.col("smell_type").startswith("clone_"), "duplicate_block").otherwise("quality_issue")
    return out.withColumn("finding_type", kind).withColumn("finding_id", F.sha2(F.concat_ws("|", "file_path", "line_start", "target", "smell_type"), 256))


def clones(a: Audit, least_lines: int = 3) -> DataFrame:
    place = F.concat("file_path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    return C.clone_groups(a.blocks, least_lines=least_lines, place=place)


def unused(a: Audit, least: float = 0.5, library: bool = False, details: DataFrame | None = None) -> DataFrame:
    """Functions, methods and classes that no other file names (M15, P16); the names
    that a module exports are known from ``details``."""
    dynamic = a.dependencies.where(F.substring_index("target_external", ".", -1).isin("getattr", "eval", "exec", "import_module", "__import__")).groupBy("file_path").agg(F.bool_or(F.col("target_external").contains("import")).alias("dynamic_import"), F.lit(True).alias("dynamic"))
    symbols = a.symbols.where("kind IN ('function', 'method', 'class')").join(dynamic, "file_path", "left").na.fill(False, ["dynamic_import", "dynamic"]).withColumn("file_id", F.col("file_path"))
    if details is not None:
        exports = details.where("detail = 'export'").select("file_path", "name").distinct().withColumn("exported", F.lit(True))
        symbols = symbols.join(exports, ["file_path", "name"], "left")
    tail = F.substring_index("target_external", ".", -1)
    uses = a.dependencies.select(tail.alias("name"), F.col("file_path").alias("file_id")).unionByName(a.accesses.select(F.col("attribute_name").alias("name"), F.col("file_path").alias("file_id")))
    return R.unused_symbols(symbols, uses, least, library)


def unreachable(a: Audit) -> DataFrame:
    """Modules that no entry point reaches by imports (G3, G4): entry points are
    tests, well-known names and modules that call main."""
    modules = a.symbols.where("kind = 'module'").select("symbol_uid", "file_path", "qualified_name", "name")
    edges = extract.resolved(a.dependencies.where("dependency_kind = 'imports'"), a.symbols).join(a.symbols.select(F.col("symbol_uid").alias("target_uid"), F.col("file_path").alias("to_file")), "target_uid")
    mains = a.dependencies.where("target_external = 'main'").select("file_path").distinct().withColumn("has_main", F.lit(True))
    tests = a.files.where("is_test_file").select("file_path").withColumn("is_test", F.lit(True))
    marked = modules.join(mains, "file_path", "left").join(tests, "file_path", "left")
    start = marked.where(F.col("has_main") | F.col("is_test") | F.col("name").isin("main", "__main__", "cli", "app", "manage", "setup", "conftest")).select("file_path")
    if start.isEmpty():
        start = modules.agg(F.min("file_path").alias("file_path"))
    hit = G.reachable(edges, start, "file_path", "to_file")
    return modules.join(hit.select(F.col("node").alias("file_path")), "file_path", "left_anti")


def statistics(found: DataFrame) -> DataFrame:
    """Numbers by type, severity and confidence band."""
    return found.withColumn("band", A.band(F.col("confidence"))).groupBy("finding_type", "severity", "band").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("n_files"))


def hotspots(found: DataFrame) -> DataFrame:
    """Files by weighed findings."""
    return A.weighted_hotspots(found, "file_path", "severity", F.col("confidence"), "target", [F.desc("confidence"), F.col("finding_id")])


def health(found: DataFrame, files: DataFrame) -> DataFrame:
    """Health of the project, 0 to 100."""
    out = A.health_penalty(found, "severity", "finding_type").withColumn("k", F.lit(1)).join(files.agg(F.count("*").alias("n_files")).withColumn("k", F.lit(1)), "k").drop("k")
    score = A.health_score(F.col("penalty"), F.col("n_files"))
    return out.withColumn("score_raw", score).withColumn("score", F.rint("score_raw").cast("int"))


def decisions(a: Audit, found: DataFrame) -> DataFrame:
    """Ranked decisions."""
    smells = found.where("finding_type = 'quality_issue'").select("smell_type", "severity", "target", "confidence")
    dead = found.where("smell_type = 'unused'").select("target", "confidence")
    return R.decisions(C.ranked_clones(clones(a), a.blocks), smells, dead)


def file_graph(a: Audit) -> DataFrame:
    """Edges between files by kind, with their weight."""
    to = a.symbols.select(F.col("symbol_uid").alias("target_uid"), F.col("file_path").alias("to_file"))
    out = extract.resolved(a.dependencies, a.symbols).join(to, "target_uid").where("file_path != to_file")
    return out.groupBy(F.col("file_path").alias("from_file"), "to_file", "dependency_kind").agg(F.count("*").alias("weight"))


def neighbors(edges: DataFrame, path: str, most: int = 30) -> DataFrame:
    """A file's neighbours by weight (J7, T2): a ranked report, hence the limit."""
    both = J.edge_neighbors(edges, "from_file", "to_file", "out", "in").where(F.col("node") == path)
    out = both.withColumn("relation", F.concat_ws("_", "dependency_kind", "relation")).groupBy("neighbor", "relation").agg(F.sum("weight").alias("edge_count"))
    return out.orderBy(F.desc("edge_count"), "neighbor", "relation").limit(most)


def refactoring_path(found: DataFrame) -> DataFrame:
    """The worst file's findings as numbered steps: duplicates, clean-up, quality."""
    worst = hotspots(found).orderBy(F.desc("score"), "file_path").limit(1).select("file_path")
    phase = F.when(F.col("finding_type") == "duplicate_block", 1).when(F.col("finding_type") == "unused_code", 2).otherwise(3)
    mine = found.join(worst, "file_path", "left_semi").withColumn("phase", phase)
    return mine.withColumn("step", F.row_number().over(Window.partitionBy("file_path").orderBy("phase", F.desc("confidence"), "finding_id")))
