"""Operators on facts of source code, run on the star tables in the roles of
facts: parts are symbols, suppliers files, line items dependencies and attribute
accesses, events findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sinks
from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import decomposition as D
from ..operators import joins as J
from ..operators import lookups as L
from ..operators import rules as R
from ..operators import similarity as C
from ..sources.tables import Tables
from . import audit, experts, views
from .registry import query

_FACTS = """WITH sym AS (SELECT 'p' || p_partkey AS symbol_uid, 'f' || p_partkey % 10 AS file_path, p_name AS name, p_brand || '.' || p_name AS qualified_name,
CASE p_type WHEN 'PROMO' THEN 'class' WHEN 'SMALL' THEN 'method' WHEN 'LARGE' THEN 'module' ELSE 'function' END AS kind, p_size AS complexity_score, p_size * 2 AS lines_of_code, p_partkey AS line_start,
p_partkey % 3 > 0 AS is_public, p_brand || p_name AS token_fingerprint, p_type AS semantic_category FROM part),
fil AS (SELECT 'f' || s_suppkey AS file_path, CAST(floor(abs(s_acctbal)) AS INT) AS lines_of_code, s_suppkey % 5 = 0 AS is_test_file FROM supplier),
dep AS (SELECT 'p' || l_partkey AS source_uid, CASE WHEN l_linenumber <= 4 THEN 'p' || l_suppkey END AS target_uid, 'x' || l_suppkey AS target_external,
CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'uses_attr' END AS dependency_kind, 'f' || l_partkey % 10 AS file_path, CAST(l_linenumber AS INT) AS line FROM lineitem),
acc AS (SELECT 'p' || l_partkey AS symbol_uid, l_linestatus || l_linenumber AS attribute_name, 'f' || l_partkey % 10 AS file_path FROM lineitem WHERE l_quantity >= 25),
fnd AS (SELECT event_id AS finding_id, 'f' || user_id % 12 AS file_path, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity,
CASE event_type WHEN 'view' THEN 'unused_code' WHEN 'click' THEN 'quality_issue' ELSE 'duplicate_block' END AS finding_type, least(1.0, value / 100) AS confidence, 't' || user_id AS target FROM events)
"""


def _facts(t: Tables, name: str) -> DataFrame:
    """One of the fact tables above, by the same text."""
    for table in ("part", "supplier", "lineitem", "events"):
        getattr(t, table).createOrReplaceTempView(table)
    return t.spark.sql(_FACTS + f"SELECT * FROM {name}")


def _audit(t: Tables) -> audit.Audit:
    blocks = _facts(t, "sym").select(F.concat(F.lit("b"), "symbol_uid").alias("block_uid"), "symbol_uid", "file_path", "lines_of_code")
    return audit.Audit(_facts(t, "fil"), _facts(t, "sym"), blocks, _facts(t, "dep"), _facts(t, "acc"), _facts(t, "fil").limit(0))


# lookups


@query(_FACTS + "SELECT symbol_uid, line_start FROM sym WHERE file_path = 'f3'")
def symbols_of_file(t: Tables) -> DataFrame:
    """F1-F3, F14."""
    return L.lookup(_facts(t, "sym"), ["line_start"], file_path="f3").select("symbol_uid", "line_start")


@query(_FACTS + "SELECT target_external, dependency_kind, count(*)::BIGINT AS usage_count, min(line) AS first_line FROM dep WHERE source_uid = 'p7' GROUP BY 1, 2")
def dependencies_of_symbol(t: Tables) -> DataFrame:
    """Counted edges of one symbol."""
    from ..sources.extract import counted_dependencies

    deps = _facts(t, "dep").withColumns({"resolution": F.lit("probable"), "confidence": F.lit(0.7)})
    return L.lookup(counted_dependencies(deps), source_uid="p7").select("target_external", "dependency_kind", "usage_count", "first_line")


@query(_FACTS + "SELECT attribute_name, count(*)::BIGINT AS n FROM acc WHERE symbol_uid = 'p7' GROUP BY 1")
def accesses_of_symbol(t: Tables) -> DataFrame:
    """F6."""
    return A.breakdown(L.lookup(_facts(t, "acc"), symbol_uid="p7"), ["attribute_name"])


@query(_FACTS + "SELECT s.qualified_name, s.line_start, f.lines_of_code AS file_lines FROM sym s JOIN fil f USING (file_path) WHERE kind = 'method'")
def method_infos(t: Tables) -> DataFrame:
    """All methods with their file."""
    files = _facts(t, "fil").select("file_path", F.col("lines_of_code").alias("file_lines"))
    return L.lookup(_facts(t, "sym"), kind="method").join(files, "file_path").select("qualified_name", "line_start", "file_lines")


@query(_FACTS + "SELECT symbol_uid, complexity_score FROM sym WHERE kind = 'method' AND complexity_score > 10")
def complex_methods(t: Tables) -> DataFrame:
    """F12."""
    return L.lookup(_facts(t, "sym"), kind="method").where("complexity_score > 10").orderBy(F.desc("complexity_score"), "symbol_uid").select("symbol_uid", "complexity_score")


@query(_FACTS + "SELECT finding_id, severity FROM fnd WHERE finding_type = 'unused_code' AND confidence >= 0.5 UNION ALL SELECT finding_id, severity FROM fnd WHERE severity = 'critical'")
def findings_by(t: Tables) -> DataFrame:
    """F13, F15."""
    found = _facts(t, "fnd")
    sure = L.lookup(found, finding_type="unused_code").where("confidence >= 0.5")
    return sure.unionByName(L.lookup(found, severity="critical")).select("finding_id", "severity")


@query(_FACTS + "SELECT symbol_uid FROM sym WHERE name = 'red ring' OR qualified_name = 'red ring' ORDER BY symbol_uid LIMIT 1")
def symbol_by_name(t: Tables) -> DataFrame:
    """F19, F18."""
    return L.chosen_columns(L.by_name(_facts(t, "sym"), "red ring", "symbol_uid"), ["symbol_uid"], {"symbol_uid", "name"})


@query(_FACTS + "SELECT symbol_uid, name FROM sym WHERE (name ILIKE '%RING%' OR qualified_name ILIKE '%RING%') AND kind = 'class'")
def symbol_search(t: Tables) -> DataFrame:
    """F9."""
    return L.search(_facts(t, "sym"), "RING", ["name", "qualified_name"], kind="class").select("symbol_uid", "name")


@query(_FACTS + "SELECT symbol_uid, complexity_score FROM sym ORDER BY complexity_score DESC, symbol_uid LIMIT 25")
def most_complex(t: Tables) -> DataFrame:
    """A ranked report, hence the limit."""
    return L.top_k(_facts(t, "sym"), 25, F.desc("complexity_score"), "symbol_uid").select("symbol_uid", "complexity_score")


# joins


@query(_FACTS + """SELECT d.source_uid, coalesce(s.symbol_uid, d.target_external) AS target_name, s.symbol_uid IS NOT NULL AS is_internal, count(*)::BIGINT AS n
FROM dep d JOIN sym a ON a.symbol_uid = d.source_uid LEFT JOIN sym s ON s.symbol_uid = d.target_uid GROUP BY 1, 2, 3""")
def resolved_edges(t: Tables) -> DataFrame:
    """J3."""
    edges = _facts(t, "dep").select("target_external", F.col("source_uid").alias("s"), F.col("target_uid").alias("g"))
    nodes = _facts(t, "sym").select("symbol_uid", F.col("symbol_uid").alias("k"))
    out = J.resolved_edges(edges, nodes, "s", "g", "target_external", "k", "symbol_uid")
    return out.groupBy("source_uid", "target_name", "is_internal").agg(F.count("*").alias("n"))


@query(_FACTS + "SELECT source_uid, line FROM dep WHERE target_uid = 'p5' OR target_external = 'p5'")
def symbol_usages(t: Tables) -> DataFrame:
    """J4."""
    return J.usages(_facts(t, "dep"), "p5").select("source_uid", "line")


@query(_FACTS + "SELECT symbol_uid, symbol_uid IN (SELECT target_uid FROM dep WHERE target_uid IS NOT NULL) AS used FROM sym")
def symbols_used(t: Tables) -> DataFrame:
    """J5."""
    return J.used_flags(_facts(t, "sym"), _facts(t, "dep"), "symbol_uid", "target_uid").select("symbol_uid", "used")


@query(_FACTS + "SELECT file_path, count(*)::BIGINT AS n FROM dep WHERE target_external = 'x1' OR starts_with(target_external, 'x1.') GROUP BY 1")
def importers_of_module(t: Tables) -> DataFrame:
    """J6."""
    return A.breakdown(J.equal_or_below(_facts(t, "dep"), "target_external", "x1"), ["file_path"])


@query(_FACTS + """, o AS (SELECT DISTINCT split_part(qualified_name, '.', 1) AS qn, file_path FROM sym)
SELECT qn, count(*)::BIGINT AS n FROM o JOIN sym s ON s.file_path = o.file_path AND starts_with(s.qualified_name, qn || '.') GROUP BY 1""")
def nested_members(t: Tables) -> DataFrame:
    """J12."""
    sym = _facts(t, "sym")
    outer = sym.select(F.substring_index("qualified_name", ".", 1).alias("qn"), "file_path").distinct()
    return A.breakdown(J.nested_members(outer, sym.select("file_path", "qualified_name"), "file_path", "qn", "qualified_name"), ["qn"])


@query(_FACTS + ", u AS (SELECT file_path, name, min(symbol_uid) AS symbol_uid FROM sym GROUP BY 1, 2 HAVING count(*) = 1) SELECT file_path, name, symbol_uid FROM u")
def unique_names(t: Tables) -> DataFrame:
    """J20."""
    return J.unique_names(_facts(t, "sym"), ["file_path", "name"], "symbol_uid")


@query("""WITH a AS (SELECT s_suppkey AS k, '/root/src/' || s_suppkey % 7 || '/' || s_name AS path FROM supplier), r AS (SELECT DISTINCT s_suppkey % 3 || '/' || s_name AS rel FROM supplier UNION SELECT s_name FROM supplier WHERE s_suppkey % 2 = 0)
SELECT k, (SELECT arg_max(rel, length(rel)) FROM r WHERE path = rel OR ends_with(path, '/' || rel)) AS rel FROM a""")
def suffix_paths(t: Tables) -> DataFrame:
    """J18."""
    a = t.supplier.selectExpr("s_suppkey AS k", "'/root/src/' || s_suppkey % 7 || '/' || s_name AS path")
    r = t.supplier.selectExpr("s_suppkey % 3 || '/' || s_name AS rel").union(t.supplier.where("s_suppkey % 2 = 0").select("s_name"))
    return J.suffix_join(a, r, "path", "rel").select("k", "rel")


@query(_FACTS + """, n AS (SELECT qualified_name AS x FROM sym WHERE kind = 'class' UNION SELECT 'a.b.' || p_name FROM part WHERE p_size > 45)
SELECT symbol_uid FROM sym WHERE kind <> 'class' AND name IN (SELECT regexp_replace(x, '^.*[.]', '') FROM n)""")
def names_outside(t: Tables) -> DataFrame:
    """J27."""
    sym = _facts(t, "sym")
    sets = [sym.where("kind = 'class'").select("qualified_name"), t.part.where("p_size > 45").select(F.concat(F.lit("a.b."), "p_name").alias("x"))]
    return J.name_evidence(sym.where("kind != 'class'"), sets).select("symbol_uid")


@query(_FACTS + "SELECT file_path, finding_type, count(*)::BIGINT AS n, sum(finding_id)::BIGINT AS ids FROM fnd GROUP BY 1, 2 HAVING count(*) > 1")
def same_type_findings(t: Tables) -> DataFrame:
    """Findings of one type in one file."""
    out = J.same_type_groups(_facts(t, "fnd"))
    return out.select("file_path", "finding_type", "n", F.aggregate("members", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))


@query(_FACTS + """, w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\w+')) AS w FROM documents), n AS (SELECT DISTINCT substr(p_name, 1, 3) AS name FROM part)
SELECT name FROM n WHERE EXISTS (SELECT 1 FROM documents WHERE contains(text, name))""")
def names_within_texts(t: Tables) -> DataFrame:
    """Names that stand anywhere in a text."""
    return J.named_within(t.part.select(F.substring("p_name", 1, 3).alias("name")), "name", t.documents, "text")


# aggregates and views


@query(_FACTS + """SELECT f.file_path, f.lines_of_code, f.is_test_file, coalesce(s.n, 0)::BIGINT AS n_symbols, coalesce(s.m, 0.0)::DOUBLE AS mean_complexity, coalesce(p.n, 0)::BIGINT AS n_findings, coalesce(p.h, 0)::BIGINT AS n_severe
FROM fil f LEFT JOIN (SELECT file_path, count(*) AS n, avg(complexity_score) AS m FROM sym GROUP BY 1) s USING (file_path)
LEFT JOIN (SELECT file_path, count(*) AS n, count(*) FILTER (severity IN ('critical', 'high')) AS h FROM fnd GROUP BY 1) p USING (file_path)""")
def file_stats(t: Tables) -> DataFrame:
    """J13, A11, A12, K10, A5."""
    return views.file_stats(_audit(t), _facts(t, "fnd"))


@query(_FACTS + """SELECT s.symbol_uid, s.qualified_name, s.kind, coalesce(o.n, 0)::BIGINT AS n_out, coalesce(i.n, 0)::BIGINT AS n_in, coalesce(a.n, 0)::BIGINT AS n_attributes FROM sym s
LEFT JOIN (SELECT source_uid AS symbol_uid, count(DISTINCT coalesce(target_uid, target_external)) AS n FROM dep GROUP BY 1) o USING (symbol_uid)
LEFT JOIN (SELECT target_uid AS symbol_uid, count(DISTINCT source_uid) AS n FROM dep WHERE target_uid IS NOT NULL GROUP BY 1) i USING (symbol_uid)
LEFT JOIN (SELECT symbol_uid, count(DISTINCT attribute_name) AS n FROM acc GROUP BY 1) a USING (symbol_uid)""")
def symbol_edges(t: Tables) -> DataFrame:
    """J14, A12, A23."""
    return views.symbol_relationships(_audit(t), _facts(t, "dep"))


@query(_FACTS + "SELECT token_fingerprint, count(*)::BIGINT AS n, string_agg(qualified_name, ';' ORDER BY qualified_name) AS names, count(DISTINCT file_path)::BIGINT AS n_files FROM sym WHERE kind <> 'module' GROUP BY 1 HAVING count(*) > 1")
def duplicate_analysis(t: Tables) -> DataFrame:
    """A12, J10."""
    return views.duplicate_analysis(_audit(t))


@query(_FACTS + "SELECT 'files' AS name, count(*)::BIGINT AS n FROM fil UNION ALL SELECT 'symbols', count(*) FROM sym UNION ALL SELECT 'blocks', count(*) FROM sym UNION ALL SELECT 'dependencies', count(*) FROM dep UNION ALL SELECT 'accesses', count(*) FROM acc UNION ALL SELECT 'errors', 0")
def fact_counts(t: Tables) -> DataFrame:
    """A6, D5."""
    return views.counts(_audit(t))


@query(_FACTS + "SELECT kind, semantic_category, count(*)::BIGINT AS n, avg(complexity_score) AS mean_complexity FROM sym GROUP BY GROUPING SETS ((kind), (semantic_category), ())")
def fact_breakdowns(t: Tables) -> DataFrame:
    """A7, A8."""
    return views.breakdowns(_audit(t))


@query(_FACTS + "SELECT target_external, dependency_kind, count(*)::BIGINT AS n FROM dep WHERE target_uid IS NULL GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 50")
def external_targets(t: Tables) -> DataFrame:
    """A10: a ranked report, hence the limit."""
    return views.external_targets(_audit(t), _facts(t, "dep"), 50)


@query(_FACTS + "SELECT 'b' || symbol_uid AS block_uid, qualified_name, kind, f.is_test_file FROM sym JOIN fil f USING (file_path)")
def block_context(t: Tables) -> DataFrame:
    """J2."""
    return views.block_context(_audit(t)).select("block_uid", "qualified_name", "kind", "is_test_file")


@query(_FACTS + "SELECT a.qualified_name AS source, b.qualified_name AS target, dependency_kind, count(*)::BIGINT AS n FROM dep JOIN sym a ON a.symbol_uid = source_uid JOIN sym b ON b.symbol_uid = target_uid WHERE dependency_kind IN ('calls', 'imports') GROUP BY 1, 2, 3")
def dependency_edges(t: Tables) -> DataFrame:
    """J15."""
    return A.breakdown(views.dependency_edges(_facts(t, "dep"), _facts(t, "sym"), ("calls", "imports")), ["source", "target", "dependency_kind"])


@query(_FACTS + """, f AS (SELECT finding_type AS advice, finding_id % 97 AS savings, target FROM fnd), r AS (SELECT *, row_number() OVER (PARTITION BY advice ORDER BY savings DESC, target) AS i FROM f)
SELECT advice, count(*)::BIGINT AS n, sum(savings)::BIGINT AS savings, string_agg(CASE WHEN i <= 3 THEN target END, ',' ORDER BY target) AS examples FROM r GROUP BY 1""")
def duplication_patterns(t: Tables) -> DataFrame:
    """A29, W3."""
    found = _facts(t, "fnd").select(F.col("finding_type").alias("advice"), (F.col("finding_id") % 97).alias("savings"), "target")
    return views.duplication_patterns(found).withColumn("examples", F.array_join("examples", ","))


@query(_FACTS + """SELECT (SELECT count(*) FILTER (kind = 'class') FROM sym)::BIGINT AS classes, (SELECT count(*) FILTER (kind IN ('function', 'method')) FROM sym)::BIGINT AS functions, (SELECT sum(complexity_score) FROM sym)::BIGINT AS complexity,
count(*)::BIGINT AS files, count(*) FILTER (is_test_file)::BIGINT AS test_files, sum(lines_of_code)::BIGINT AS lines, count(*) FILTER (is_test_file)::DOUBLE / count(*) AS test_share FROM fil""")
def project_metrics(t: Tables) -> DataFrame:
    """A26, P15."""
    return views.project_metrics(_audit(t))


@query(_FACTS + "SELECT file_path, count(*)::BIGINT AS n, lines_of_code, (count(*) * lines_of_code)::BIGINT AS weight FROM fnd JOIN fil USING (file_path) GROUP BY file_path, lines_of_code ORDER BY weight DESC, file_path LIMIT 10")
def refactoring_candidates(t: Tables) -> DataFrame:
    """A ranked report, hence the limit."""
    return views.refactoring_candidates(_facts(t, "fnd"), _facts(t, "fil"))


@query(_FACTS + "SELECT target_external AS symbol, count(*)::BIGINT AS uses, count(DISTINCT file_path)::BIGINT AS n_files FROM dep GROUP BY 1 ORDER BY uses DESC, symbol LIMIT 10")
def usage_ranking(t: Tables) -> DataFrame:
    """A ranked report, hence the limit."""
    return views.usage_ranking(_facts(t, "dep").select(F.col("target_external").alias("symbol"), "file_path", F.lit(1).alias("uses")))


@query(_FACTS + "SELECT finding_type, severity, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*)::BIGINT AS n, count(DISTINCT file_path)::BIGINT AS n_files FROM fnd GROUP BY 1, 2, 3")
def finding_statistics(t: Tables) -> DataFrame:
    """A15, A18."""
    return audit.statistics(_facts(t, "fnd"))


@query("""SELECT p_brand, avg(p_size) AS mean, min(p_size) AS least, max(p_size) AS most, round(stddev(p_size), 9) AS deviation FROM part GROUP BY 1""")
def benchmark_statistics(t: Tables) -> DataFrame:
    """A32."""
    return A.summary_stats(t.part, ["p_brand"], "p_size").withColumn("deviation", F.round("deviation", 9))


@query(_FACTS + """, c AS (SELECT target_uid, CASE line % 5 WHEN 0 THEN 'builtin' WHEN 1 THEN 'unknown' WHEN 2 THEN 'external' WHEN 3 THEN 'standard' ELSE 'dynamic_attribute' END AS call_class FROM dep)
SELECT count(target_uid)::DOUBLE / count(*) AS resolved, count(target_uid)::DOUBLE / count(*) FILTER (target_uid IS NOT NULL OR call_class IN ('unknown', 'dynamic_attribute')) AS resolved_internal,
count(target_uid) FILTER (call_class <> 'builtin')::DOUBLE / count(*) FILTER (call_class <> 'builtin') AS resolved_without_builtins FROM c""")
def resolution_rates(t: Tables) -> DataFrame:
    """A21."""
    return D.resolution_rates(_facts(t, "dep").withColumn("call_class", F.expr("CASE line % 5 WHEN 0 THEN 'builtin' WHEN 1 THEN 'unknown' WHEN 2 THEN 'external' WHEN 3 THEN 'standard' ELSE 'dynamic_attribute' END")))


@query(_FACTS + """, b AS (SELECT kind AS category, semantic_category AS subcategory, file_path AS module FROM sym), o AS (SELECT category, subcategory, module, count(*) AS n FROM b GROUP BY 1, 2, 3)
SELECT category, subcategory, sum(n)::BIGINT AS n, arg_min(module, {'n': -n, 'm': module}) AS owner, count(*)::BIGINT AS n_modules FROM o GROUP BY 1, 2 HAVING sum(n) >= 2""")
def capabilities(t: Tables) -> DataFrame:
    """A20."""
    return D.capabilities(_facts(t, "sym").select(F.col("kind").alias("category"), F.col("semantic_category").alias("subcategory"), F.col("file_path").alias("module")))


@query(_FACTS + """, c AS (SELECT DISTINCT file_path AS test, name FROM sym WHERE complexity_score > 25), a AS (SELECT DISTINCT name FROM sym WHERE kind = 'class'), x AS (SELECT count(*) AS n FROM a),
e AS (SELECT test, round(100.0::DOUBLE * count(*) FILTER (name IN (SELECT name FROM a)) / (SELECT n FROM x), 9) AS percent FROM c GROUP BY 1) SELECT test, percent FROM e UNION ALL SELECT NULL, round(avg(percent), 6) FROM e""")
def test_coverage_share(t: Tables) -> DataFrame:
    """A34."""
    sym = _facts(t, "sym")
    out = experts.coverage_share(sym.where("kind = 'class'"), "test", sym.where("complexity_score > 25").select(F.col("file_path").alias("test"), "name"))
    return out.select("test", F.when(F.col("test").isNull(), F.round("percent", 6)).otherwise(F.round("percent", 9)).alias("percent"))


# sets, sinks


@query(_FACTS + """, new AS (SELECT symbol_uid, complexity_score + 1 AS complexity_score FROM sym WHERE complexity_score > 40 UNION ALL SELECT 'q' || p_partkey, 0 FROM part WHERE p_size < 3)
SELECT symbol_uid, complexity_score FROM sym WHERE symbol_uid NOT IN (SELECT symbol_uid FROM new) UNION ALL FROM new""")
def upserted(t: Tables) -> DataFrame:
    """K1, K2, U7."""
    old = _facts(t, "sym").select("symbol_uid", "complexity_score")
    new = old.where("complexity_score > 40").withColumn("complexity_score", F.col("complexity_score") + 1).union(t.part.where("p_size < 3").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")), F.lit(0)))
    return sinks.merged(old, new, ["symbol_uid"])


@query(_FACTS + "SELECT symbol_uid, file_path FROM sym WHERE file_path IN (SELECT file_path FROM fil WHERE NOT is_test_file)")
def cascade_deleted(t: Tables) -> DataFrame:
    """K3, K8, J9."""
    return sinks.without_orphans(_facts(t, "sym"), _facts(t, "fil").where("NOT is_test_file"), "file_path").select("symbol_uid", "file_path")


@query(_FACTS + ", g AS (SELECT name, list(symbol_uid ORDER BY symbol_uid) AS m FROM sym GROUP BY 1 HAVING count(*) > 1) SELECT name, array_to_string(m, '; ') AS members FROM g")
def flat_groups(t: Tables) -> DataFrame:
    """Arrays as text for CSV."""
    groups = A.repeated_groups(_facts(t, "sym"), "name", "symbol_uid").select("name", "members")
    return sinks.flat(groups)


# names, categories, contexts

_WORDS = "['test_load', 'validate', 'reset_db', 'parse_x', 'save_all', 'is_ready', 'compute', 'checkout', 'render_log', 'authorize', 'runner', 'entry_old', '__len__', '_start', 'zzz']"
_NAME = f"(list_extract({_WORDS}, (p_partkey % 15)::INT + 1) || '_' || replace(p_name, ' ', '_'))"


def _named(t: Tables) -> DataFrame:
    words = _WORDS.replace("[", "array(").replace("]", ")")
    return t.part.withColumn("name", F.expr(f"element_at({words}, CAST(p_partkey % 15 AS INT) + 1) || '_' || replace(p_name, ' ', '_')"))


def _case(column: str, table: dict[str, tuple[str, ...]], default: str) -> str:
    """SQL for the first entry of which a word stands in a column."""
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{k}'" for k, words in table.items()) + f" ELSE {default} END"


_CATEGORY_SQL = "CASE WHEN regexp_matches(n, 'test|check|verify|validate') THEN 'validation' WHEN regexp_matches(n, 'transform|convert|parse') THEN 'transformation' WHEN regexp_matches(n, 'save|load|store|db') THEN 'persistence' WHEN regexp_matches(n, 'get|set|is') THEN 'access' ELSE 'business_logic' END"
_DUTY = (
    ("data", "load|save|read|write|parse|serialize|deserialize"), ("validation", "validate|check|verify|ensure|assert"), ("calculation", "calculate|compute|process|transform|convert"), ("communication", "send|receive|request|response|notify"),
    ("formatting", "format|render|display|print|show"), ("logging", "log|debug|info|warn|error"), ("configuration", "config|setting|option|parameter"), ("caching", "cache|store|retrieve|invalidate"),
    ("security", "authenticate|authorize|encrypt|decrypt|hash"), ("workflow", "start|stop|pause|resume|execute|run"),
)
_DUTY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{k}'" for k, p in _DUTY) + " END"
_SURE_SQL = "CASE " + " ".join(f"WHEN contains(n, '{w}') THEN CASE WHEN starts_with(n, '{w}') THEN 0.8 ELSE 0.6 END" for _, p in _DUTY for w in p.split("|")) + " END::DOUBLE"


@query(f"SELECT p_partkey, {_CATEGORY_SQL} AS category, {_DUTY_SQL} AS duty, {_SURE_SQL} AS sure FROM (SELECT p_partkey, lower({_NAME}) AS n FROM part)")
def name_categories(t: Tables) -> DataFrame:
    """X12, M9."""
    duty, sure = R.responsibility(F.col("name"))
    return _named(t).select("p_partkey", R.name_category(F.col("name")).alias("category"), duty.alias("duty"), sure.alias("sure"))


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_filter([CASE WHEN p_size > 50 THEN 'large' WHEN p_size < 5 THEN 'small' END, CASE WHEN p_size % 13 > 10 THEN 'complex' WHEN p_size % 13 = 1 THEN 'simple' END,
CASE WHEN starts_with(n, '_') THEN 'private' ELSE 'public' END, CASE WHEN p_partkey % 2 = 0 THEN 'method' ELSE 'function' END, CASE WHEN contains(n, 'test') THEN 'test' END, CASE WHEN regexp_matches(n, 'legacy|old|deprecated') THEN 'legacy' END,
CASE WHEN regexp_matches(n, 'main|entry|start') THEN 'entry_point' END, CASE WHEN regexp_matches(lower(p_type), 'cli|command') THEN 'cli' END, CASE WHEN p_partkey % 9 > 5 THEN 'hotpath' END], lambda x: x IS NOT NULL)), ',') AS tags
FROM (SELECT *, {_NAME} AS n FROM part)""")
def block_tags(t: Tables) -> DataFrame:
    """M14."""
    marks = R.tags(F.col("p_size"), F.col("p_size") % 13, F.col("name"), F.col("p_type"), F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 9)
    return _named(t).select("p_partkey", F.array_join(marks, ",").alias("tags"))


_LITERALS = "['hello', 'SELECT x', 'https://a.b', 'a(b)c', 'Bearer token', 'config.yml', 'plain text', '^x$', 'cache', 'update it']"
_CALLS = "['json.loads', 'cursor.execute', 'log', 'self.logger.info', 'informal', 'encode', 'x.y', 'getLogger']"


@query(f"""WITH b AS (SELECT p_partkey, list_extract({_LITERALS}, (p_partkey % 10)::INT + 1) AS a, list_extract({_LITERALS}, (p_size % 10)::INT + 1) AS b, list_extract({_CALLS}, (p_partkey % 8)::INT + 1) AS c, CASE p_partkey % 11 WHEN 0 THEN 'sqlite3' WHEN 1 THEN 'yaml' ELSE 'os' END AS i FROM part),
k AS (SELECT *, CASE x WHEN 'hello' THEN NULL WHEN 'SELECT x' THEN 'persistence/sql' WHEN 'https://a.b' THEN 'networking/url' WHEN 'a(b)c' THEN 'parsing/regex' WHEN 'Bearer token' THEN 'security/token' WHEN 'config.yml' THEN 'configuration/settings' WHEN 'plain text' THEN NULL
WHEN '^x$' THEN 'parsing/regex' WHEN 'cache' THEN 'caching/storage' WHEN 'update it' THEN 'persistence/sql' END AS one FROM (SELECT p_partkey, 0 AS o, a AS x FROM b UNION ALL SELECT p_partkey, 1, b FROM b))
SELECT b.p_partkey, i = 'sqlite3' OR c = 'cursor.execute' OR regexp_matches(lower(a || chr(10) || b), 'select|insert|update|delete') AS persistence, i = 'yaml' OR c IN ('json.loads', 'encode') OR regexp_matches(lower(a || chr(10) || b), 'json|yaml|xml|csv') AS serialization,
c IN ('log', 'self.logger.info', 'getLogger') AS telemetry, (SELECT arg_min(one, o) FROM k WHERE k.p_partkey = b.p_partkey AND one IS NOT NULL) AS literal FROM b""")
def block_contexts(t: Tables) -> DataFrame:
    """P9."""
    arrays = {k: v.replace("[", "array(").replace("]", ")") for k, v in (("l", _LITERALS), ("c", _CALLS))}
    b = t.part.select(
        "p_partkey", F.expr(f"array(element_at({arrays['l']}, CAST(p_partkey % 10 AS INT) + 1), element_at({arrays['l']}, CAST(p_size % 10 AS INT) + 1))").alias("l"), F.expr(f"array(element_at({arrays['c']}, CAST(p_partkey % 8 AS INT) + 1))").alias("c"),
        F.expr("array(CASE p_partkey % 11 WHEN 0 THEN 'sqlite3' WHEN 1 THEN 'yaml' ELSE 'os' END)").alias("i"),
    )
    i, c, lit = F.col("i"), F.col("c"), F.col("l")
    out = b.select("p_partkey", R.has_context(i, c, lit, R.V.PERSISTENCE).alias("persistence"), R.has_context(i, c, lit, R.V.SERIALIZATION).alias("serialization"), R.has_telemetry(c).alias("telemetry"), R.literal_category(lit).alias("x"))
    return out.select("p_partkey", "persistence", "serialization", "telemetry", F.when(F.col("x").isNotNull(), F.concat_ws("/", "x.category", "x.subcategory")).alias("literal"))


_SOURCES = """['x = getattr(a, 1)', 'EVAL (y)', 'm = importlib.import_module("q.r")', 'pass', 'globals() and exec(z)', '__import__("os")']"""


@query(f"""WITH s AS (SELECT 'd/' || p_brand || '.py' AS f, p_partkey AS k, list_extract({_SOURCES}, (p_partkey % 6)::INT + 1) AS x FROM part WHERE p_size > 10), t AS (SELECT f, string_agg(x, chr(10) ORDER BY k) AS c FROM s GROUP BY 1),
n AS (SELECT f, len(regexp_extract_all(c, '(?i)getattr\\s*\\(')) + len(regexp_extract_all(c, '(?i)hasattr\\s*\\(')) + len(regexp_extract_all(c, '(?i)importlib\\.')) + len(regexp_extract_all(c, '(?i)__import__\\s*\\(')) + len(regexp_extract_all(c, '(?i)eval\\s*\\('))
+ len(regexp_extract_all(c, '(?i)exec\\s*\\(')) + len(regexp_extract_all(c, '(?i)globals\\s*\\(\\)')) AS plain, len(regexp_extract_all(c, '(?i)importlib\\.import_module\\s*\\(\\s*"[^"]*"')) + len(regexp_extract_all(c, '(?i)__import__\\s*\\(\\s*"[^"]*"')) AS named FROM t),
m AS (SELECT f, least(50, plain + named) AS n_signs, least(50, plain + named) - least(50, plain) AS n_imports FROM n WHERE plain + named > 0)
SELECT f AS file_path, CASE WHEN n_imports > 0 THEN 'dynamic_import_' ELSE 'dynamic_usage_' END || substr(f, 3) AS symbol_name, CASE WHEN n_imports > 0 THEN 0.4 ELSE 0.3 END::DOUBLE AS confidence, n_signs::BIGINT AS n_signs, n_imports::BIGINT AS n_imports FROM m""")
def dynamic_usage(t: Tables) -> DataFrame:
    """M16."""
    text = _SOURCES.replace("[", "array(", 1)[:-1] + ")"
    one = t.part.where("p_size > 10").select(F.concat(F.lit("d/"), "p_brand", F.lit(".py")).alias("file_path"), F.struct("p_partkey", F.expr(f"element_at({text}, CAST(p_partkey % 6 AS INT) + 1)").alias("x")).alias("s"))
    files = one.groupBy("file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["x"]), "\n").alias("content"))
    return R.dynamic_findings(R.dynamic_uses(files, "file_path", "content"), "file_path").select("file_path", "symbol_name", "confidence", "n_signs", "n_imports")


# clusters

_ANTONYMS_SQL = " OR ".join(f"(bool_or(contains(n, '{a}')) AND bool_or(contains(n, '{b}')))" for a, b in R.V.ANTONYMS)
_VARIANTS_SQL = " OR ".join(f"(bool_or(contains(n, '{v}')) AND bool_or(NOT contains(n, '{v}')))" for v in ("_no_signal", "_strict", "_unsafe", "_legacy", "_fast", "_slow", "_v2"))
_MODAL_SQL = " OR ".join(f"(bool_or(starts_with(n, '{m}')) AND bool_or(NOT starts_with(n, '{m}')))" for m in ("can_", "is_", "has_"))


@query(f"""WITH m AS (SELECT p_name || p_type AS c, lower({_NAME}) AS n FROM part), g AS (SELECT c, bool_or(starts_with(n, '__') AND ends_with(n, '__')) AS dunder, {_MODAL_SQL} AS modal, {_ANTONYMS_SQL} OR {_VARIANTS_SQL} AS o, list(n) AS ns FROM m GROUP BY 1)
SELECT c AS cluster, dunder, modal, o OR modal OR len(list_filter(ns, lambda x: contains(x, '_no_') AND list_contains(ns, replace(x, '_no_', '_')))) > 0 AS opposite FROM g""")
def cluster_guards(t: Tables) -> DataFrame:
    """P6."""
    members = _named(t).select(F.concat("p_name", "p_type").alias("cluster"), "name")
    return D.name_guards(members, "cluster", "name").select("cluster", "dunder", "modal", "opposite")


@query("""WITH g AS (SELECT p_name AS c, p_brand AS cat, count(*) AS n, sum(p_size)::BIGINT AS loc, max(p_size) AS cx, sum(p_partkey % 4)::BIGINT AS callers, min(p_partkey) % 50 / 50.0::DOUBLE AS mean, min(p_partkey) % 11 = 0 AS d, min(p_partkey) % 7 = 0 AS mo, min(p_partkey) % 5 = 0 AS o,
min(p_partkey) % 10 / 10.0::DOUBLE AS ns, max(p_size % 6) - min(p_size % 6) <= 2 AS fit, min(p_type) AS sub FROM part GROUP BY 1, 2),
a AS (SELECT *, CASE WHEN d OR mo THEN 'KEEP_SEPARATE' WHEN o THEN CASE WHEN mean >= 0.7 THEN 'EXTRACT_BASE' ELSE 'KEEP_SEPARATE' END WHEN mean >= 0.85 THEN CASE WHEN ns < 0.6 THEN 'EXTRACT_BASE' WHEN fit THEN 'MERGE' ELSE 'WRAP_ONLY' END
WHEN mean >= 0.7 THEN 'EXTRACT_BASE' ELSE 'KEEP_SEPARATE' END AS advice, CASE WHEN mean < 0.6 THEN 'HIGH' WHEN callers > 10 OR cx > 15 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM g),
e AS (SELECT *, CASE advice WHEN 'KEEP_SEPARATE' THEN 'XS' WHEN 'WRAP_ONLY' THEN 'S' WHEN 'MERGE' THEN CASE WHEN n <= 2 AND loc <= 50 THEN 'S' WHEN n <= 4 AND loc <= 100 THEN 'M' ELSE 'L' END ELSE CASE WHEN loc <= 100 THEN 'M' ELSE 'L' END END AS effort FROM a),
b AS (SELECT *, n * 2.0::DOUBLE + mean * 10.0::DOUBLE + CASE advice WHEN 'MERGE' THEN 5.0 WHEN 'EXTRACT_BASE' THEN 3.0 WHEN 'WRAP_ONLY' THEN 1.0 ELSE 0.0 END::DOUBLE + CASE risk WHEN 'LOW' THEN 3.0 WHEN 'MEDIUM' THEN 1.0 ELSE 0.0 END::DOUBLE
+ CASE effort WHEN 'XS' THEN 5.0 WHEN 'S' THEN 4.0 WHEN 'M' THEN 2.0 ELSE 1.0 END::DOUBLE AS benefit FROM e)
SELECT c AS cluster, cat AS category, advice, risk, effort, benefit, 'unified/' || cat || '.py::' || sub || '_' || replace(c, ' ', '_') AS target,
row_number() OVER (ORDER BY CASE risk WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, CASE effort WHEN 'XS' THEN 0 WHEN 'S' THEN 1 WHEN 'M' THEN 2 ELSE 3 END, n, c, cat)::INT AS place FROM b""")
def cluster_advice(t: Tables) -> DataFrame:
    """Groups of parts as clusters."""
    return _clusters(t).select("cluster", "category", "advice", "risk", "effort", "benefit", "target", "place")


def _clusters(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    parts = t.part.withColumn("sig", F.concat(F.lit("f("), F.array_join(F.expr("array_repeat('a', p_size % 6)"), ", "), F.lit(")")))
    first = F.min("p_partkey")
    g = parts.groupBy(F.col("p_name").alias("cluster"), F.col("p_brand").alias("category")).agg(
        F.count("*").alias("members"), F.sum("p_size").alias("lines"), F.max("p_size").alias("complex"), F.sum(F.col("p_partkey") % 4).alias("callers"), (first % 50 / 50).alias("mean"), (first % 11 == 0).alias("dunder"), (first % 7 == 0).alias("modal"),
        (first % 5 == 0).alias("opposite"), (first % 10 / 10).alias("alike"), F.min("p_type").alias("sub"),
    )
    fit = C.signatures_fit(parts.select(F.concat_ws("|", "p_name", "p_brand").alias("k"), "sig"), "k", "sig")
    c = g.withColumn("k", F.concat_ws("|", "cluster", "category")).join(fit, "k").drop("k")
    c = c.withColumn("advice", C.recommendation(*(F.col(x) for x in ("mean", "dunder", "modal", "opposite", "alike", "compatible"))))
    c = c.withColumn("risk", D.risk(F.col("mean"), F.col("callers"), F.col("complex")))
    c = c.withColumn("effort", D.effort(F.col("advice"), F.col("members"), F.col("lines")))
    c = c.withColumn("benefit", D.benefit(F.col("members"), F.col("mean"), F.col("advice"), F.col("risk"), F.col("effort")))
    c = c.withColumn("target", D.target_name(F.col("category"), F.col("sub"), F.replace(F.col("cluster"), F.lit(" "), F.lit("_"))))
    return c.withColumn("place", F.row_number().over(Window.orderBy(*D.plan_order(F.col("risk"), F.col("effort"), F.col("members")), "cluster", "category")))  # a plan's clusters are few


@query("""WITH m AS (SELECT p_name AS c, p_partkey AS k, (p_partkey % 4) * 0.3::DOUBLE + greatest(0.0::DOUBLE, 20.0::DOUBLE - p_size) / 20.0::DOUBLE * 0.2::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(p_size * 2 - 20.0::DOUBLE) / 50.0::DOUBLE) * 0.2::DOUBLE + (p_partkey % 10) / 10.0::DOUBLE * 0.3::DOUBLE AS s FROM part)
SELECT c AS cluster, arg_min(k, {'s': -s, 'k': k}) AS canonical, max(s) AS score FROM m GROUP BY 1""")
def canonical_member(t: Tables) -> DataFrame:
    """C25."""
    members = t.part.select(F.col("p_name").alias("cluster"), F.col("p_partkey").alias("k"), (F.col("p_partkey") % 4).alias("fan_in"), F.col("p_size").alias("complexity"), (F.col("p_size") * 2).alias("lines"), (F.col("p_partkey") % 10 / 10).alias("mean_similarity"))
    return C.canonical(members, "cluster", "k")


@query("""WITH f AS (SELECT p_name, p_partkey % 5 AS g, min(p_partkey) AS k FROM part GROUP BY 1, 2), p AS (SELECT a.*, b.p_partkey AS bk, b.p_type AS bt, b.p_brand AS bb, b.p_size AS bs FROM part a JOIN f ON a.p_partkey = f.k JOIN part b ON b.p_name = f.p_name AND b.p_partkey % 5 = f.g AND b.p_partkey > a.p_partkey),
c AS (SELECT p_partkey AS a, bk AS b, CASE WHEN p_type = bt THEN 1.0 ELSE 0.0 END::DOUBLE AS ast, CASE WHEN p_size % 4 = bs % 4 THEN 1.0::DOUBLE ELSE (CASE WHEN p_brand = bb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN p_type = bt THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 2.0::DOUBLE END AS tok,
(CASE WHEN p_size % 3 = bs % 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + 1.0::DOUBLE + (CASE WHEN p_size % 6 = bs % 6 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(p_size % 6 - bs % 6) / 10.0::DOUBLE) END
 + CASE WHEN p_size % 6 = 0 AND bs % 6 = 0 OR p_size % 6 > 0 AND bs % 6 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN p_brand = bb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 3.0::DOUBLE) / 3.0::DOUBLE AS sig,
(CASE WHEN p_brand = bb THEN 1 ELSE 0 END + CASE WHEN p_type = bt THEN 1 ELSE 0 END)::DOUBLE / (4 - (CASE WHEN p_brand = bb THEN 1 ELSE 0 END + CASE WHEN p_type = bt THEN 1 ELSE 0 END)) AS dep, CASE WHEN p_size % 2 = bs % 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS lit FROM p)
SELECT a, b, round(least(1.0::DOUBLE, (ast * 0.3::DOUBLE + tok * 0.2::DOUBLE + sig * 0.15::DOUBLE + dep * 0.15::DOUBLE + lit * 0.1::DOUBLE + 0.1::DOUBLE) / 1.0::DOUBLE), 9) AS similarity FROM c""")
def block_similarity(t: Tables) -> DataFrame:
    """Each part with the first of its name and residue."""
    b = t.part.selectExpr(
        "p_partkey AS k", "p_name AS name", "p_name || p_partkey % 5 AS g", "p_type AS ast", "'t' || p_size % 4 AS token", "array(p_brand) AS calls", "array(p_type) AS imports", "CAST(array() AS ARRAY<STRING>) AS globals", "array('i' || p_size % 3) AS inputs",
        "CAST(array() AS ARRAY<STRING>) AS outputs", "'f(' || array_join(array_repeat('a', p_size % 6), ', ') || ') -> ' || p_brand AS signature", "array('s' || p_size % 2) AS literals",
    )
    pairs = J.representative_pairs(b.select("k", "g"), "g", "k").select(F.col("first_member").alias("a"), F.col("k").alias("b"))
    side = lambda s: b.drop("g").select(F.col("k").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in b.columns if c not in ("k", "g")))
    return C.channel_similarity(pairs.join(side("a"), "a").join(side("b"), "b")).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("""WITH s AS (SELECT p_name AS c, count(*) AS n FROM part GROUP BY 1), p AS (SELECT a.p_name AS c, (a.p_partkey + b.p_partkey) % 10 / 10.0::DOUBLE AS x FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
SELECT s.c AS cluster, n::BIGINT AS n, round(CASE WHEN n > 1 THEN coalesce((SELECT sum(x) FROM p WHERE p.c = s.c), 0.0) / (n * (n - 1) / 2) ELSE 1.0 END, 9)::DOUBLE AS mean_similarity FROM s""")
def cluster_means(t: Tables) -> DataFrame:
    """C23."""
    m = t.part.select(F.col("p_name").alias("cluster"), F.col("p_partkey").alias("k"), "p_brand")
    pairs = m.select("cluster", "p_brand", F.col("k").alias("a")).join(m.select("cluster", "p_brand", F.col("k").alias("b")), ["cluster", "p_brand"]).where("a < b").select("a", "b", ((F.col("a") + F.col("b")) % 10 / 10).alias("similarity"))
    return C.cluster_means(m.select("cluster", "k"), pairs, "cluster", "k").select("cluster", "n", F.round("mean_similarity", 9).alias("mean_similarity"))


@query("""SELECT p_name || p_brand AS cluster, CASE WHEN count(DISTINCT p_partkey % 2) > 1 THEN 'mixed callable kinds' WHEN count(DISTINCT p_type) > 1 THEN 'different signatures' WHEN count(DISTINCT p_size) > 1 THEN 'different bodies' ELSE 'SAFE_EXACT' END AS verdict FROM part GROUP BY 1""")
def safe_exact(t: Tables) -> DataFrame:
    """C27."""
    same = F.lit("x")
    members = t.part.select(F.concat("p_name", "p_brand").alias("cluster"), (F.col("p_partkey") % 2).alias("callable_kind"), same.alias("method_name"), same.alias("decorator_kind"), F.col("p_type").alias("signature_shape"), same.alias("free_names"), F.col("p_size").alias("fingerprint"))
    return C.safe_exact(members, "cluster")


_MATCHES = """WITH f AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1), p AS (SELECT a.*, b.p_partkey AS bk, b.p_type AS bt, b.p_brand AS bb, b.p_size AS bs FROM f JOIN part a ON a.p_partkey = f.k JOIN part b ON b.p_name = f.p_name AND b.p_partkey > f.k),
q AS (SELECT p_partkey AS a, bk AS b, p_size AS az, bs AS bz, CASE WHEN p_size % 4 = 0 AND bs % 4 = 0 THEN 0.5 WHEN p_size % 4 = 0 OR bs % 4 = 0 THEN 0.0 WHEN p_type = bt AND p_brand = bb THEN 1.0 WHEN p_type = bt OR p_brand = bb THEN 1.0::DOUBLE / 3 ELSE 0.0 END::DOUBLE AS s,
CASE WHEN p_brand = bb THEN 1.0 ELSE 1.0::DOUBLE / 3 END::DOUBLE AS j, p_size % 3 = bs % 3 AND p_size % 3 > 0 AS pat,
(CASE WHEN p_size % 5 = bs % 5 THEN CASE WHEN p_size % 5 = 0 THEN 0.5 ELSE 1.0 END ELSE 0.0 END::DOUBLE * 0.6::DOUBLE + CASE WHEN p_size % 2 = 0 AND bs % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE * 0.2::DOUBLE + 1.0::DOUBLE * 0.2::DOUBLE) / (0.6::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE) AS be,
CASE WHEN p_partkey % 10 >= 8 AND bk % 10 >= 8 THEN 0.15 WHEN p_partkey % 10 >= 6 AND bk % 10 >= 6 THEN 0.1 ELSE 0.0 END::DOUBLE AS sure FROM p),
r AS (SELECT *, CASE WHEN pat THEN 0.8::DOUBLE + 0.2::DOUBLE * j ELSE j END AS fu FROM q), m AS (SELECT *, (s >= 0.8)::INT AS ms, (fu >= 0.7)::INT AS mf, (be >= 0.6)::INT AS mb FROM r),
n AS (SELECT *, ms + mf + mb AS n FROM m WHERE ms + mf + mb > 0),
o AS (SELECT a, b, CASE WHEN n > 1 THEN 'hybrid' WHEN ms = 1 THEN 'structural' WHEN mf = 1 THEN 'functional' ELSE 'behavioral' END AS match_type,
CASE WHEN n > 1 THEN (s * 0.4::DOUBLE * ms + fu * 0.4::DOUBLE * mf + be * 0.2::DOUBLE * mb) / (0.4::DOUBLE * ms + 0.4::DOUBLE * mf + 0.2::DOUBLE * mb) ELSE s * ms + fu * mf + be * mb END::DOUBLE AS score,
least(1.0, (s * ms + fu * mf + be * mb) / n * 0.6 + sure + least(az, bz)::DOUBLE / greatest(az, bz) * 0.1 + least(az, bz)::DOUBLE / greatest(az, bz) * 0.1 + CASE WHEN n > 1 THEN 0.05 ELSE 0.0 END)::DOUBLE AS confidence FROM n)
"""


@query(_MATCHES + """SELECT a, b, match_type, round(score, 9) AS score, round(confidence, 9) AS confidence, CASE WHEN score >= 0.9 THEN CASE match_type WHEN 'structural' THEN 'Extract common method - methods are nearly identical' WHEN 'functional' THEN 'Create template method - same functionality with parameter differences'
WHEN 'behavioral' THEN 'Unify behavior - methods have same responsibilities' ELSE 'Full merge candidate - methods are highly similar across multiple dimensions' END
WHEN score >= 0.8 THEN CASE match_type WHEN 'functional' THEN 'Parameterize differences - extract common logic with parameters' WHEN 'behavioral' THEN 'Create shared interface - methods have similar behavior patterns' ELSE 'Partial merge - extract common parts into shared utility' END
WHEN score >= 0.7 THEN 'Consider refactoring - methods share significant similarities' ELSE 'Monitor for patterns - methods have some similarities worth tracking' END AS advice FROM o WHERE confidence >= 0.5""")
def method_matches(t: Tables) -> DataFrame:
    """The first part of each name with its others."""
    m = t.part.selectExpr(
        "p_partkey", "p_name", "CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type || '_' || p_brand END AS ast", "array('read', p_brand, 'unknown') AS ops", "CASE p_size % 3 WHEN 0 THEN 'unknown' ELSE 'p' || p_size % 3 END AS pattern",
        "CASE p_size % 5 WHEN 0 THEN 'unknown' ELSE 'c' || p_size % 5 END AS category", "CASE WHEN p_size % 2 = 0 THEN array('m') ELSE CAST(array() AS ARRAY<STRING>) END AS markers", "CAST(array() AS ARRAY<STRING>) AS effects", "p_partkey % 10 / 10 AS sure", "p_size AS complexity", "p_size AS lines",
    )
    pairs = J.representative_pairs(m.select("p_partkey", "p_name"), "p_name", "p_partkey").select(F.col("first_member").alias("a"), F.col("p_partkey").alias("b"))
    side = lambda s: m.select(F.col("p_partkey").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in m.columns[2:]))
    out = C.method_similarity(pairs.join(side("a"), "a").join(side("b"), "b"))
    return out.select("a", "b", "match_type", F.round("score", 9).alias("score"), F.round("confidence", 9).alias("confidence"), D.merge_strategy(F.col("match_type"), F.col("score")).alias("advice"))


@query(f"""WITH b AS (SELECT p_partkey, p_size, lower({_NAME}) AS n FROM part),
o AS (SELECT p_partkey, list_concat(CASE p_size % 5 WHEN 0 THEN ['validate'] WHEN 1 THEN ['transform'] WHEN 2 THEN ['load', 'save'] WHEN 3 THEN ['compute'] ELSE [] END, CASE p_size % 4 WHEN 0 THEN ['fetch'] WHEN 1 THEN ['process'] ELSE [] END, CASE p_size % 7 WHEN 0 THEN ['fetch', 'send'] WHEN 1 THEN ['read', 'write'] ELSE [] END,
CASE WHEN contains(n, 'check') THEN ['check'] WHEN contains(n, 'validate') THEN ['validate'] ELSE [] END, CASE WHEN regexp_matches(n, 'save|store') THEN ['store'] ELSE [] END, CASE WHEN regexp_matches(n, 'load|get|fetch') THEN ['fetch'] ELSE [] END) AS l FROM b),
d AS (SELECT p_partkey, coalesce((SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i) GROUP BY x)), ['unknown']) AS l FROM o)
SELECT p_partkey, array_to_string(l, '->') AS operations, CASE WHEN list_has_all(l, ['load', 'validate', 'save']) THEN 'load_validate_save' WHEN list_has_all(l, ['fetch', 'process', 'store']) THEN 'fetch_process_store'
WHEN len(list_intersect(l, ['validate', 'check'])) > 0 AND len(list_intersect(l, ['transform', 'process'])) > 0 THEN 'validate_transform_return' ELSE 'unknown' END AS pattern FROM d""")
def method_operations(t: Tables) -> DataFrame:
    """C15, P5."""
    category = F.expr("CASE p_size % 5 WHEN 0 THEN 'validation' WHEN 1 THEN 'transformation' WHEN 2 THEN 'persistence' WHEN 3 THEN 'computation' ELSE 'utility' END")
    markers = F.expr("CASE p_size % 4 WHEN 0 THEN array('data_access') WHEN 1 THEN array('business_logic') ELSE array('logging') END")
    effects = F.expr("CASE p_size % 7 WHEN 0 THEN array('network') WHEN 1 THEN array('file_io') ELSE CAST(array() AS ARRAY<STRING>) END")
    ops = _named(t).select("p_partkey", D.operations(F.col("name"), category, markers, effects).alias("o"))
    return ops.select("p_partkey", F.array_join("o", "->").alias("operations"), D.pattern(F.col("o")).alias("pattern"))


@query(f"""WITH n AS (SELECT p_partkey AS k, p_name AS g, p_brand AS tok, p_type AS ast, 'c' || p_size % 3 AS cat, p_size AS cx, lower({_NAME}) AS name FROM part), f AS (SELECT g, min(k) AS k FROM n GROUP BY 1),
p AS (SELECT a.k AS a, b.k AS b, CASE WHEN a.tok = b.tok THEN 1.0 WHEN a.ast = b.ast THEN 0.9 ELSE CASE WHEN a.cat = b.cat THEN 0.3 ELSE 0.0 END + CASE WHEN least(a.cx, b.cx)::DOUBLE / greatest(a.cx, b.cx) > 0.8 THEN 0.2 ELSE 0.0 END
+ CASE WHEN len(list_filter(string_split(a.name, '_'), lambda w: contains(b.name, w))) > 0 THEN 0.2 ELSE 0.0 END END::DOUBLE AS similarity FROM f JOIN n a ON a.k = f.k JOIN n b ON b.g = f.g AND b.k > f.k)
SELECT a, b, round(similarity, 6) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(similarity, 6) DESC, b) <= 5""")
def symbol_likeness(t: Tables) -> DataFrame:
    """The five most like the first of each name."""
    n = _named(t).select(F.col("p_partkey").alias("k"), F.col("p_name").alias("g"), F.col("p_brand").alias("token"), F.col("p_type").alias("ast"), F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")).alias("category"), F.col("p_size").alias("complexity"), "name")
    pairs = J.representative_pairs(n.select("k", "g"), "g", "k").select(F.col("first_member").alias("a"), F.col("k").alias("b"))
    side = lambda s: n.select(F.col("k").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in n.columns[2:]))
    return D.similar_symbols(pairs.join(side("a"), "a").join(side("b"), "b"), 5).select("a", "b", F.round("similarity", 6).alias("similarity"))


# scores and advice


_HELD = " + ".join(f"CASE WHEN p_partkey % {k + 2} > 0 THEN {w} ELSE 0 END" for k, w in enumerate(R.V.COMPONENT_WEIGHTS.values()))


@query(f"""WITH s AS (SELECT p_partkey, p_size, {_HELD} AS quality, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 0 END
+ CASE WHEN p_size > 10 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 9 > 5 THEN 1 ELSE 0 END AS points FROM part)
SELECT p_partkey, CASE WHEN p_size > 10 THEN 'critical' WHEN p_size > 5 THEN 'high' WHEN p_size > 2 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN p_size > 10 THEN 'high' WHEN p_size > 3 THEN 'medium' ELSE 'low' END AS effort, quality::DOUBLE AS quality,
CASE WHEN points >= 6 THEN 'critical' WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS overall FROM s""")
def change_scores(t: Tables) -> DataFrame:
    """M20, M23, P20."""
    held = {c: F.col("p_partkey") % (k + 2) > 0 for k, c in enumerate(R.V.COMPONENT_WEIGHTS)}
    df = t.part.withColumns(held)
    overall = R.analysis_risk(F.col("call_graph"), F.col("external_callers"), F.col("test_discovery"), F.col("behavioral_contracts"), F.col("p_size"), F.col("p_partkey") % 9)
    return df.select("p_partkey", R.change_risk(F.col("p_size")).alias("risk"), R.migration_effort(F.col("p_size")).alias("effort"), R.quality_score().alias("quality"), overall.alias("overall"))


@query("""SELECT p_partkey, unnest(list_filter([CASE WHEN p_size * 40 > 1000 AND p_partkey % 9 > 3 AND p_partkey % 10 < 5 THEN 'god_class' END, CASE WHEN p_partkey % 3 = 0 AND p_size * 40 > 200 AND p_partkey % 9 > 4 THEN 'large_configuration' END, CASE WHEN p_size / 50.0 > 0.7 THEN 'tight_coupling' END,
CASE WHEN p_partkey % 10 < 4 THEN 'low_cohesion' END], lambda x: x IS NOT NULL)) AS opportunity FROM part""")
def opportunity_rules(t: Tables) -> DataFrame:
    """M22."""
    df = t.part.selectExpr("p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN 'a/My_Settings.py' ELSE 'a/b.py' END AS file_path", "p_size * 40 AS lines", "p_partkey % 9 AS responsibility_count", "p_size / 50 AS coupling", "p_partkey % 10 / 10 AS cohesion")
    return R.opportunities(df).select("p_partkey", "opportunity")


@query("""WITH f AS (SELECT p_partkey AS k, p_size * 50 AS lines, p_size * 8 AS cx, p_partkey % 3 AS gods, p_partkey % 2 AS items, p_partkey % 6 AS duties, p_partkey % 5 AS depth, p_partkey % 14 AS nested FROM part),
i AS (SELECT *, list_concat(list_filter([CASE WHEN lines > 1000 THEN 'very large file' WHEN lines > 500 THEN 'large file' END, CASE WHEN cx > 300 THEN 'critical complexity' WHEN cx > 150 THEN 'high complexity' END], lambda x: x IS NOT NULL), list_resize(CAST([] AS VARCHAR[]), gods, 'god object'),
list_filter([CASE WHEN items > 0 THEN 'complex methods' END, CASE WHEN depth >= 3 THEN 'deep nesting' END, CASE WHEN nested > 10 THEN 'many nested definitions' END], lambda x: x IS NOT NULL)) AS l FROM f)
SELECT k, array_to_string(l, ',') AS issues, least(10, 1 + CASE WHEN lines > 2000 THEN 4 WHEN lines > 1000 THEN 3 WHEN lines > 500 THEN 2 ELSE 0 END + least(gods * 2, 4) + least(len(l), 3) + CASE WHEN depth >= 3 THEN 1 ELSE 0 END)::BIGINT AS priority,
least(10, CASE WHEN gods > 0 THEN 4 ELSE 0 END + CASE WHEN lines > 500 THEN 3 ELSE 0 END + CASE WHEN cx > 150 OR items > 0 THEN 2 ELSE 0 END + CASE WHEN duties > 3 THEN 2 ELSE 0 END)::DOUBLE / 10 AS automation FROM i""")
def file_issues(t: Tables) -> DataFrame:
    """M21."""
    s, k = F.col("p_size"), F.col("p_partkey")
    df = t.part.select(k.alias("k"), (s * 50).alias("lines"), (s * 8).alias("complexity"), (k % 3).alias("god_objects"), (k % 2).alias("complex_items"), (k % 6).alias("most_duties"), (k % 5).alias("nested_depth"), (k % 14).alias("nested_definitions"))
    return D.file_issues(df).select("k", F.array_join("issues", ",").alias("issues"), F.col("priority").cast("long").alias("priority"), "automation")


@query("""WITH t AS (SELECT p_partkey AS k, p_size % 8 AS n, p_partkey % 2 = 0 AS d, p_partkey % 3 = 0 AS m, p_partkey % 5 = 0 AS tr, p_partkey % 7 = 0 AS sw, p_partkey % 11 = 0 AS su, p_partkey % 13 = 0 AS cx, p_partkey % 4 = 0 AS e FROM part),
s AS (SELECT k, 50 + CASE WHEN n > 0 THEN least(n * 6, 25) ELSE -35 END + d::INT * 8 + m::INT * 8 - tr::INT * 20 - sw::INT * 30 - su::INT * 12 - cx::INT * 10 + e::INT * 6 AS q, 50 + CASE WHEN n > 0 THEN least(n * 6, 25) ELSE -35 END + d::INT * 6 + m::INT * 8 - tr::INT * 30 - sw::INT * 30 - su::INT * 15 - cx::INT * 10 + e::INT * 4 AS g FROM t),
c AS (SELECT k, greatest(0, least(100, q))::INT AS quality, greatest(0, least(100, g))::INT AS signal FROM s)
SELECT k, quality, signal, CASE WHEN signal >= 70 THEN 'high' WHEN signal >= 40 THEN 'medium' ELSE 'low' END AS band, signal < 30 AS noise FROM c""")
def test_signals(t: Tables) -> DataFrame:
    """A33, E15."""
    k = F.col("p_partkey")
    flags = {"documented": 2, "mocks": 3, "trivial": 5, "swallows": 7, "suspicious": 11, "too_complex": 13, "edge_case": 4}
    tests = t.part.select(k.alias("k"), (F.col("p_size") % 8).alias("asserts"), *((k % n == 0).alias(c) for c, n in flags.items()))
    return R.test_signal(tests).select("k", "quality", "signal", "band", "noise")


@query("""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'MERGE' WHEN 1 THEN 'EXTRACT_BASE' WHEN 2 THEN 'WRAP_ONLY' ELSE 'KEEP_SEPARATE' END AS r FROM part)
SELECT k, unnest(generate_series(1, CASE r WHEN 'MERGE' THEN 4 WHEN 'EXTRACT_BASE' THEN 3 WHEN 'WRAP_ONLY' THEN 2 ELSE 0 END))::INT AS step_no FROM p""")
def plan_steps(t: Tables) -> DataFrame:
    """M24, P11."""
    plans = t.part.selectExpr("p_partkey AS k", "CASE p_partkey % 4 WHEN 0 THEN 'MERGE' WHEN 1 THEN 'EXTRACT_BASE' WHEN 2 THEN 'WRAP_ONLY' ELSE 'KEEP_SEPARATE' END AS recommendation")
    return R.steps(plans).select("k", "step_no")


@query(_FACTS + """, r AS (SELECT *, CASE finding_type WHEN 'duplicate_block' THEN 1 WHEN 'unused_code' THEN 2 ELSE 3 END AS phase FROM fnd),
h AS (SELECT file_path, sum(round(confidence * 1000000)::BIGINT * CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 24 WHEN 'medium' THEN 12 ELSE 4 END) AS s FROM fnd GROUP BY 1), w AS (SELECT file_path FROM h ORDER BY s DESC, file_path LIMIT 1)
SELECT finding_id, phase, row_number() OVER (ORDER BY phase, confidence DESC, finding_id)::INT AS step FROM r SEMI JOIN w USING (file_path)""")
def refactoring_path(t: Tables) -> DataFrame:
    """P32, T1."""
    return audit.refactoring_path(_facts(t, "fnd")).select("finding_id", "phase", "step")


@query(_FACTS + """, e AS (SELECT a.file_path AS f, b.file_path AS g, dependency_kind, count(*) AS w FROM dep JOIN sym a ON a.symbol_uid = source_uid JOIN sym b ON b.symbol_uid = target_uid WHERE a.file_path <> b.file_path GROUP BY 1, 2, 3),
n AS (SELECT g AS neighbor, dependency_kind || '_out' AS relation, w FROM e WHERE f = 'f1' UNION ALL SELECT f, dependency_kind || '_in', w FROM e WHERE g = 'f1')
SELECT neighbor, relation, sum(w)::BIGINT AS edge_count FROM n GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 30""")
def file_neighbors(t: Tables) -> DataFrame:
    """A ranked report, hence the limit."""
    sym = _facts(t, "sym")
    edges = _facts(t, "dep").drop("file_path").join(sym.select(F.col("symbol_uid").alias("source_uid"), F.col("file_path").alias("from_file")), "source_uid").join(sym.select(F.col("symbol_uid").alias("target_uid"), F.col("file_path").alias("to_file")), "target_uid")
    edges = edges.where("from_file != to_file").groupBy("from_file", "to_file", "dependency_kind").agg(F.count("*").alias("weight"))
    return audit.neighbors(edges, "f1")


@query("SELECT p_partkey, CASE WHEN starts_with(v, 'https://') THEN 'url' WHEN contains(v, '@') THEN 'email' WHEN contains(v, '/') THEN 'path' WHEN v = 'true' THEN 'boolean' WHEN v = 'v1.2' THEN 'version' WHEN v = 'MAX_SIZE' THEN 'constant' ELSE 'short' END AS class FROM (SELECT p_partkey, list_extract(['https://a.b/c', 'a@b.cd', 'x/y', 'true', 'v1.2', 'MAX_SIZE', 'word'], (p_partkey % 7)::INT + 1) AS v FROM part)")
def literal_classes(t: Tables) -> DataFrame:
    """Pattern classes of literals."""
    v = F.expr("element_at(array('https://a.b/c', 'a@b.cd', 'x/y', 'true', 'v1.2', 'MAX_SIZE', 'word'), CAST(p_partkey % 7 AS INT) + 1)")
    return t.part.select("p_partkey", S.literal_class(v).alias("class"))


# reports


@query(_FACTS + """SELECT s.file_path, count(*) FILTER (kind = 'class')::BIGINT AS classes, count(*) FILTER (kind IN ('function', 'method'))::BIGINT AS functions, sum(complexity_score)::BIGINT AS complexity, max(complexity_score) AS most_complex,
coalesce((SELECT count(DISTINCT target_external) FROM dep d WHERE dependency_kind = 'imports' AND d.file_path = s.file_path), 0)::BIGINT AS imports FROM sym s GROUP BY 1""")
def file_metrics(t: Tables) -> DataFrame:
    """P13."""
    return views.file_metrics(_audit(t))


@query(_FACTS + """, a AS (SELECT DISTINCT file_path, symbol_uid FROM sym WHERE complexity_score < 40), b AS (SELECT DISTINCT file_path, symbol_uid FROM sym WHERE complexity_score > 10)
SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN a.symbol_uid IS NOT NULL AND b.symbol_uid IS NOT NULL THEN 'kept' WHEN b.symbol_uid IS NOT NULL THEN 'added' ELSE 'removed' END AS change, count(*)::BIGINT AS n FROM a FULL JOIN b ON a.file_path = b.file_path AND a.symbol_uid = b.symbol_uid GROUP BY 1, 2""")
def compared_modules(t: Tables) -> DataFrame:
    """P18."""
    sym = _facts(t, "sym")
    return views.compared_symbols(sym.where("complexity_score < 40"), sym.where("complexity_score > 10"), "symbol_uid", "file_path")


@query(_FACTS + """, f AS (SELECT DISTINCT file_path FROM fnd), s AS (SELECT file_path, 2 AS phase, 'apply_opportunity' AS operation, 'Apply: ' || finding_type AS description, finding_id AS p FROM fnd UNION ALL SELECT file_path, 0, 'create_backup', NULL, 0 FROM f
UNION ALL SELECT file_path, 1, 'validate_syntax', NULL, 0 FROM f UNION ALL SELECT file_path, 3, 'validate_syntax', NULL, 0 FROM f) SELECT file_path, phase, operation, description, row_number() OVER (PARTITION BY file_path ORDER BY phase, p)::INT AS step FROM s""")
def refactoring_plan(t: Tables) -> DataFrame:
    """P36."""
    return views.plan_rows(_facts(t, "fnd"), "file_path", "finding_type", "finding_id")


@query(_FACTS + """, s AS (SELECT *, CASE WHEN severity IN ('critical', 'high') THEN 'requirements' WHEN finding_type = 'quality_issue' THEN 'design' ELSE 'implementation' END AS section FROM fnd),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY confidence DESC, finding_id) AS i FROM s) SELECT section, count(*)::BIGINT AS n, count(DISTINCT file_path)::BIGINT AS n_files, string_agg(CASE WHEN i <= 3 THEN finding_id::VARCHAR END, ',' ORDER BY i) AS first FROM r GROUP BY 1""")
def specification_sections(t: Tables) -> DataFrame:
    """M25."""
    return views.sections(_facts(t, "fnd"))


@query("""WITH g AS (SELECT p_brand AS c, count(*) AS n, min(p_size) AS s FROM part GROUP BY 1) SELECT CASE WHEN s % 2 = 0 THEN 'LOW' ELSE 'HIGH' END AS risk, CASE WHEN n % 3 = 0 THEN 'S' ELSE 'M' END AS effort, count(*)::BIGINT AS n_clusters, sum(n)::BIGINT AS n_members, sum(n * 2)::DOUBLE AS benefit FROM g GROUP BY 1, 2""")
def cluster_report(t: Tables) -> DataFrame:
    """P12."""
    g = t.part.groupBy("p_brand").agg(F.count("*").alias("members"), F.min("p_size").alias("s"))
    return D.cluster_report(g.select("members", F.expr("IF(s % 2 = 0, 'LOW', 'HIGH')").alias("risk"), F.expr("IF(members % 3 = 0, 'S', 'M')").alias("effort"), (F.col("members") * 2.0).alias("benefit")))


@query("""SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \t\r\x0b\f]+|[ \t\r\x0b\f]+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '#')))::INT AS lines FROM documents""")
def code_lines(t: Tables) -> DataFrame:
    """P4."""
    return t.documents.select("doc_id", S.code_lines(F.col("text")).alias("lines"))


_STATEMENTS = "['SELECT a FROM part JOIN lineitem', 'select x from nowhere', 'INSERT INTO Orders VALUES', 'UPDATE missing SET a = 1', 'nothing here']"


@query(rf"""WITH s AS (SELECT p_partkey, list_extract({_STATEMENTS}, (p_partkey % 5)::INT + 1) || '; ' || list_extract({_STATEMENTS}, (p_size % 5)::INT + 1) AS x FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(x, '(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+([A-Za-z_]+)', 1), lambda n: lower(n)), lambda n: n NOT IN ('part', 'lineitem', 'orders')))), ',') AS unknown FROM s""")
def unknown_tables(t: Tables) -> DataFrame:
    """D9."""
    words = _STATEMENTS.replace("[", "array(").replace("]", ")")
    text = F.expr(f"element_at({words}, CAST(p_partkey % 5 AS INT) + 1) || '; ' || element_at({words}, CAST(p_size % 5 AS INT) + 1)")
    return t.part.select("p_partkey", F.array_join(S.unknown_tables(text, ("part", "lineitem", "orders")), ",").alias("unknown"))


@query(r"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \t\r\x0b\f]+|[ \t\r\x0b\f]+$', '', 'g')) AS l FROM documents), s AS (SELECT doc_id, l, unnest(generate_series(3, least(20, len(l) // 2) - 1)) AS size FROM l WHERE least(20, len(l) // 2) > 3),
w AS (SELECT doc_id, size, l, unnest(generate_series(1, len(l) - size + 1)) AS start FROM s), c AS (SELECT doc_id, size, start, list_filter(l[start:start + size - 1], lambda x: x <> '' AND NOT starts_with(x, '#')) AS b FROM w),
g AS (SELECT doc_id, size, md5(array_to_string(b, chr(10))) AS digest, list(start ORDER BY start) AS p FROM c WHERE len(b) >= 3 GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT doc_id, size::INT AS size, digest, array_to_string(p, ',') AS starts, (size * (len(p) - 1))::INT AS savings FROM g""")
def repeated_windows(t: Tables) -> DataFrame:
    """E8, W5, A29."""
    return C.repeated_windows(t.documents, "doc_id", "text").select("doc_id", "size", "digest", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"), "savings")
