"""Views, statistics and reports over facts and findings (A6, A7, A10, A16-A18,
A24, A26, A29-A31, J2, J15, K10, D2-D8, M25, P13, P18, P36)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from .audit import Audit


def file_stats(a: Audit, found: DataFrame) -> DataFrame:
    """Symbols and findings of each file, each side aggregated by itself."""
    s = a.symbols.groupBy("file_path").agg(F.count("*").alias("n_symbols"), F.avg("complexity_score").alias("mean_complexity"))
    p = found.groupBy("file_path").agg(F.count("*").alias("n_findings"), F.count_if(F.col("severity").isin("critical", "high")).alias("n_severe"))
    return a.files.select("file_path", "lines_of_code", "is_test_file").join(s, "file_path", "left").join(p, "file_path", "left").na.fill(0)


def symbol_relationships(a: Audit, edges: DataFrame) -> DataFrame:
    """Edges out and in, and attributes, of each symbol (K10, J14): three
    aggregates, no product. edges: source_uid, target_uid, target_external."""
    out = edges.groupBy(F.col("source_uid").alias("symbol_uid")).agg(F.count_distinct(F.coalesce("target_uid", "target_external")).alias("n_out"))
    into = edges.where("target_uid IS NOT NULL").groupBy(F.col("target_uid").alias("symbol_uid")).agg(F.count_distinct("source_uid").alias("n_in"))
    attrs = a.accesses.groupBy("symbol_uid").agg(F.count_distinct("attribute_name").alias("n_attributes"))
    base = a.symbols.select("symbol_uid", "qualified_name", "kind")
    for x in (out, into, attrs):
        base = base.join(x, "symbol_uid", "left")
    return base.na.fill(0, ["n_out", "n_in", "n_attributes"])


def duplicate_analysis(a: Audit) -> DataFrame:
    """Symbols of equal text, with their names and files."""
    groups = a.symbols.where("kind != 'module' AND token_fingerprint != ''").groupBy("token_fingerprint")
    return groups.agg(F.count("*").alias("n"), A.joined(F.col("qualified_name"), ";").alias("names"), F.count_distinct("file_path").alias("n_files")).where("n > 1")


def counts(a: Audit) -> DataFrame:
    """Rows of each fact table."""
    out = None
    for name in ("files", "symbols", "blocks", "dependencies", "accesses", "errors"):
        one = getattr(a, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def breakdowns(a: Audit) -> DataFrame:
    """Symbols by kind and category in one pass, with subtotals."""
    sets = a.symbols.groupingSets([["kind"], ["semantic_category"], []], "kind", "semantic_category")
    return sets.agg(F.count("*").alias("n"), F.avg("complexity_score").alias("mean_complexity"))


def external_targets(a: Audit, edges: DataFrame, most: int) -> DataFrame:
    """External names most depended on (A10): a ranked report, hence the limit."""
    out = edges.where("target_uid IS NULL").groupBy("target_external", "dependency_kind").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "target_external", "dependency_kind").limit(most)


def block_context(a: Audit) -> DataFrame:
    """Blocks with their symbol and file."""
    s = a.symbols.select("symbol_uid", "qualified_name", "kind")
    return a.blocks.join(s, "symbol_uid").join(a.files.select("file_path", "is_test_file"), "file_path")


def dependency_edges(edges: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] = ("calls", "imports", "inherits")) -> DataFrame:
    """Edges between known symbols of the given kinds, by name."""
    s = symbols.select(F.col("symbol_uid").alias("source_uid"), F.col("qualified_name").alias("source"))
    t = symbols.select(F.col("symbol_uid").alias("target_uid"), F.col("qualified_name").alias("target"))
    return edges.where(F.col("dependency_kind").isin(*kinds)).join(s, "source_uid").join(t, "target_uid").select("source", "target", "dependency_kind")


def clone_statistics(groups: DataFrame) -> DataFrame:
    """Groups and members by type."""
    return groups.groupBy("clone_type").agg(F.count("*").alias("n_groups"), F.sum("group_size").alias("n_members"), F.max("group_size").alias("largest"), F.avg("similarity").alias("mean_similarity"))


def duplication_patterns(found: DataFrame, examples: int = 3) -> DataFrame:
    """Duplicates by advice, with lines saved and examples (A29). found: advice,
    savings, target."""
    top = A.first_per_group(found, ["advice"], [F.desc("savings"), F.col("target")], examples).groupBy("advice").agg(F.sort_array(F.collect_list("target")).alias("examples"))
    return found.groupBy("advice").agg(F.count("*").alias("n"), F.sum("savings").alias("savings")).join(top, "advice")


def project_metrics(a: Audit) -> DataFrame:
    """Sums and shares over the project."""
    s = a.symbols.agg(F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind").isin("function", "method")).alias("functions"), F.sum("complexity_score").alias("complexity"), F.lit(1).alias("k"))
    f = a.files.agg(F.count("*").alias("files"), F.count_if("is_test_file").alias("test_files"), F.sum("lines_of_code").alias("lines"), F.lit(1).alias("k"))
    return s.join(f, "k").drop("k").withColumn("test_share", F.when(F.col("files") > 0, F.col("test_files") / F.col("files")).otherwise(0.0))


def refactoring_candidates(found: DataFrame, files: DataFrame, most: int = 10) -> DataFrame:
    """Files by findings times lines (T8): a ranked report, hence the limit."""
    n = found.groupBy("file_path").agg(F.count("*").alias("n"))
    out = n.join(files.select("file_path", "lines_of_code"), "file_path").withColumn("weight", F.col("n") * F.col("lines_of_code"))
    return out.orderBy(F.desc("weight"), "file_path").limit(most)


def usage_ranking(uses: DataFrame, most: int = 10) -> DataFrame:
    """Symbols by uses from outside (A24): a ranked report, hence the limit."""
    return uses.groupBy("symbol").agg(F.sum("uses").alias("uses"), F.count_distinct("file_path").alias("n_files")).orderBy(F.desc("uses"), "symbol").limit(most)


def write_views(views: dict[str, DataFrame], folder: str) -> None:
    """Materialise views anew."""
    for name, df in views.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def compacted(spark: SparkSession, source: str, target: str, rows_per_file: int = 1_000_000) -> None:
    """A table in fewer, larger files, ordered by its first column."""
    df = spark.read.parquet(source)
    df.repartitionByRange(max(1, -(-df.count() // rows_per_file)), df.columns[0]).sortWithinPartitions(df.columns[0]).write.mode("overwrite").parquet(target)


class QueryLog:
    """Runs queries and keeps time, rows and the shape of their plans."""

    def __init__(self, spark: SparkSession, slow: float = 0.1):
        self.spark, self.slow, self.rows = spark, slow, []

    def run(self, name: str, df: DataFrame) -> int:
        plan = df._jdf.queryExecution().executedPlan().toString()
        began = time.perf_counter()
        n = df.count()
        took = time.perf_counter() - began
        self.rows.append((name, took, n, "PushedFilters: [" in plan and "PushedFilters: []" not in plan, plan.count("Exchange"), took > self.slow))
        return n

    def report(self) -> DataFrame:
        """Mean time, slow runs and share with pushed filters by query."""
        log = self.spark.createDataFrame(self.rows, "name string, seconds double, n long, pushed boolean, exchanges int, slow boolean")
        return log.groupBy("name").agg(F.count("*").alias("runs"), F.avg("seconds").alias("mean"), F.count_if("slow").alias("slow_runs"), F.avg(F.col("pushed").cast("double")).alias("pushed_share"), F.max("exchanges").alias("exchanges"))


def file_metrics(a: Audit) -> DataFrame:
    """Definitions, complexity, nesting and imports of each file."""
    s = a.symbols.groupBy("file_path").agg(
        F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind").isin("function", "method")).alias("functions"), F.sum("complexity_score").alias("complexity"), F.max("complexity_score").alias("most_complex"),
    )
    d = a.dependencies.where("dependency_kind = 'imports'").groupBy("file_path").agg(F.count_distinct("target_external").alias("imports"))
    return s.join(d, "file_path", "left").na.fill(0, ["imports"])


def compared_symbols(before: DataFrame, after: DataFrame, key: str, scope: str) -> DataFrame:
    """Symbols kept, added and removed, by scope, between two states."""
    old, new = (df.select(scope, key).distinct().withColumn(name, F.lit(True)) for df, name in ((before, "_old"), (after, "_new")))
    both = old.join(new, [scope, key], "full")
    change = F.when(F.col("_old") & F.col("_new"), "kept").when(F.col("_new"), "added").otherwise("removed")
    return both.groupBy(scope, change.alias("change")).agg(F.count("*").alias("n"))


def plan_rows(opportunities: DataFrame, file: str, text: str, order: str, backup: bool = True) -> DataFrame:
    """Steps of the plan of each file (P36): a backup, a check, its opportunities in
    order, a check of the result. Rows only: nothing is carried out."""
    step = lambda df, phase, kind: df.select(file, F.lit(phase).alias("phase"), F.lit(kind).alias("operation"))
    files = opportunities.select(file).distinct()
    before = [(0, "create_backup")] if backup else []
    fixed = [step(files, p, k).select("*", F.lit(None).cast("string").alias("description"), F.lit(0).cast("long").alias("place")) for p, k in (*before, (1, "validate_syntax"), (3, "validate_syntax"))]
    out = opportunities.select(file, F.lit(2).alias("phase"), F.lit("apply_opportunity").alias("operation"), F.concat(F.lit("Apply: "), F.col(text)).alias("description"), F.col(order).cast("long").alias("place"))
    for f in fixed:
        out = out.unionByName(f)
    return out.withColumn("step", F.row_number().over(Window.partitionBy(file).orderBy("phase", "place", "description"))).drop("place")


def sections(found: DataFrame) -> DataFrame:
    """Findings dealt into the sections of a specification, with their numbers and
    first targets (M25): requirements from severe ones, design from quality, the
    rest for implementation."""
    section = F.when(F.col("severity").isin("critical", "high"), "requirements").when(F.col("finding_type") == "quality_issue", "design").otherwise("implementation")
    by = found.withColumn("section", section)
    first = A.first_per_group(by, ["section"], [F.desc("confidence"), F.col("finding_id")], 3).groupBy("section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "finding_id"))), lambda x: x["finding_id"].cast("string")), ",").alias("first"))
    return by.groupBy("section").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("n_files")).join(first, "section")
