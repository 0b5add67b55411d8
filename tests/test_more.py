"""Decomposition, views, knowledge and settings."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import decomposition as D
from quarrylens.operators import similarity as C
from quarrylens.plans import audit, views
from quarrylens.sources import code, extract, knowledge

from .test_code import FILES


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("project2")
    for name, text in FILES.items():
        p = top / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(top), audit.facts(spark, str(top), str(tmp_path_factory.mktemp("facts2")))


def test_used_imports_and_fingerprints(spark):
    df = spark.createDataFrame([(12, "x", ["os.path.join", "dumps"], ["os.path", "json.dumps", "re"]), (14, "x", ["a", "b"], ["json", "os"])], "n int, c string, calls array<string>, imports array<string>")
    got = df.select(D.used_imports(F.col("imports"), F.col("calls")).alias("u"), D.semantic_fingerprint(F.col("n"), F.col("c"), F.col("calls"), F.col("imports")).alias("f")).collect()
    assert sorted(got[0].u) == ["json.dumps", "os.path"] and got[1].u == []
    assert len(got[0].f) == 64 and got[0].f != got[1].f


def test_aliases(spark, facts):
    root, a = facts
    details = extract.table_of(extract.facts(code.files(spark, root)), "details")
    aliases = details.where("detail = 'alias'").select("file_path", F.col("name").alias("alias"), F.col("value").alias("target"))
    calls = D.normalised_calls(a.dependencies.where("dependency_kind = 'calls'"), aliases)
    assert {r.full_name for r in calls.where("target_external = 'later'").collect()} == {"pkg.z.later"}
    assert {r.full_name for r in calls.where("target_external = 'os.path.join'").collect()} == {"os.path.join"}


def test_operations_and_advice(spark):
    rows = [("load_and_check", "persistence", ["data_access"], ["network"], None), ("x", None, None, None, ""), ("x", "validation", [], [], " Acquire -> process->RELEASE "), ("check_and_convert", "utility", [], [], None)]
    df = spark.createDataFrame(rows, "name string, category string, markers array<string>, effects array<string>, signature string")
    ops = D.operations(*(F.col(c) for c in ("name", "category", "markers", "effects", "signature")))
    got = [(r.o, r.p) for r in df.select(ops.alias("o")).select("o", D.pattern(F.col("o")).alias("p")).collect()]
    assert got == [(["load", "save", "fetch", "send", "check"], "unknown"), (["unknown"], "unknown"), (["acquire", "process", "release"], "acquire_process_release"), (["check", "transform"], "validate_transform_return")]
    one = spark.range(1).select(D.merge_strategy(F.lit("functional"), F.lit(0.85)).alias("m"), D.target_name(F.lit("parsing"), F.lit("json"), F.lit("load__x")).alias("t"), D.call_class(F.lit("self.x"), ("os",), ("len",)).alias("k"), D.unresolved_reason(F.lit("a.b"), F.lit(0), F.lit(False)).alias("r")).first()
    assert (one.m, one.t, one.k, one.r) == ("Parameterize differences - extract common logic with parameters", "unified/parsers.py::json_load_x", "dynamic_attribute", "unknown_receiver")


def test_name_guards(spark):
    groups = {"a": ["get_x", "set_x"], "b": ["run_x", "run_y"], "c": ["is_x", "run_x"], "d": ["f_fast", "f"], "e": ["a_no_b", "a_b"], "f": ["__len__", "size"], "g": ["is_x", "is_y"], "h": ["reset"], "i": ["x_strict", "x"]}
    df = spark.createDataFrame([(k, n) for k, v in groups.items() for n in v], "cluster string, name string")
    got = {r.cluster: (r.dunder, r.modal, r.opposite) for r in D.name_guards(df, "cluster", "name").collect()}
    no = (False, False, False)
    assert got == {"a": (False, False, True), "b": no, "c": (False, True, True), "d": (False, False, True), "e": (False, False, True), "f": (True, False, False), "g": no, "h": no, "i": (False, False, True)}
    alike = {r.cluster: r.name_similarity for r in D.name_guards(df, "cluster", "name").collect()}
    assert alike["b"] == pytest.approx(0.8) and alike["h"] == 1.0


def test_cluster_advice(spark):
    rows = [(0.9, False, False, False, 0.8, True), (0.9, False, False, False, 0.8, False), (0.9, False, False, False, 0.5, True), (0.9, False, False, True, 0.9, True), (0.9, True, False, False, 0.9, True), (0.6, False, False, True, 0.9, True), (0.75, False, False, False, 0.1, False), (0.6, False, False, False, 1.0, True)]
    df = spark.createDataFrame(rows, "m double, d boolean, q boolean, o boolean, n double, c boolean")
    got = df.select(C.recommendation(*(F.col(c) for c in "mdqonc"))).collect()
    assert [r[0] for r in got] == ["MERGE", "WRAP_ONLY", "EXTRACT_BASE", "EXTRACT_BASE", "KEEP_SEPARATE", "KEEP_SEPARATE", "EXTRACT_BASE", "KEEP_SEPARATE"]
    one = spark.range(1).select(D.risk(F.lit(0.9), F.lit(11), F.lit(1)).alias("r"), D.effort(F.lit("MERGE"), F.lit(3), F.lit(90)).alias("e"), D.benefit(F.lit(3), F.lit(0.9), F.lit("MERGE"), F.lit("MEDIUM"), F.lit("M")).alias("b")).first()
    assert (one.r, one.e, one.b) == ("MEDIUM", "M", 6 + 9 + 5 + 1 + 2)
    m = spark.createDataFrame([("c", "a", 5, 20, 0, 0.5, "f(x, y)"), ("c", "b", 1, 20, 2, 0.9, "f(x)"), ("c", "d", 30, 200, 0, None, "f(a, b, c, d)")], "cluster string, k string, complexity int, lines int, fan_in int, mean_similarity double, signature string")
    best = C.canonical(m, "cluster", "k").first()
    assert best.canonical == "b" and best.score == pytest.approx(2 * 0.3 + 19 / 20 * 0.2 + 0.2 + 0.9 * 0.3)
    assert not C.signatures_fit(m, "cluster", "signature").first().compatible and C.signatures_fit(m.where("k != 'd'"), "cluster", "signature").first().compatible
    plans = spark.createDataFrame([("p", "HIGH", "S", 0), ("q", "LOW", "L", 0), ("r", "LOW", "S", 2), ("s", "LOW", "S", 1)], "k string, risk string, effort string, deps int")
    assert [r.k for r in plans.orderBy(*D.plan_order(F.col("risk"), F.col("effort"), F.col("deps"))).collect()] == ["s", "r", "q", "p"]


def test_rates_and_capabilities(spark):
    calls = spark.createDataFrame([("u", "unknown"), (None, "builtin"), (None, "external"), (None, "unknown")], "target_uid string, call_class string")
    r = D.resolution_rates(calls).first()
    assert (r.resolved, r.resolved_internal, r.resolved_without_builtins) == (0.25, 0.5, pytest.approx(1 / 3))
    assert D.resolution_rates(calls.limit(0)).first().resolved == 0
    b = spark.createDataFrame([("c", "s", "m"), ("c", "s", "m"), ("c", "s", "a"), ("d", "s", "z")], "category string, subcategory string, module string")
    assert [(x.category, x.owner, x.n_modules) for x in D.capabilities(b).collect()] == [("c", "m", 2)]


def test_similar_symbols_rank_before_the_cut(spark):
    cols = "a string, b string, " + ", ".join(f"{s}_{c} {'int' if c == 'complexity' else 'string'}" for c in ("token", "ast", "category", "complexity", "name") for s in "ab")
    df = spark.createDataFrame([("x", "p", "1", "2", "s", "s", "k", "k", 1, 1, "f", "g"), ("x", "q", "1", "1", "s", "t", "k", "k", 1, 1, "f", "g"), ("x", "r", "", "", "", "", "k", "k", 10, 9, "get_all", "fetch_all"), ("x", "s", None, None, None, None, "k", "l", 10, 1, "f", "g")], cols)
    assert [(r.b, r.similarity) for r in D.similar_symbols(df, 3).orderBy("position").collect()] == [("q", 1.0), ("p", 0.9), ("r", pytest.approx(0.7))]


def test_file_issues(spark):
    df = spark.createDataFrame([(2100, 160, 1, 1, 4, 3, 11), (10, 1, 0, 0, 1, 0, 0)], "lines int, complexity int, god_objects int, complex_items int, most_duties int, nested_depth int, nested_definitions int")
    got = D.file_issues(df).collect()
    assert got[0].issues == ["very large file", "high complexity", "god object", "complex methods", "deep nesting", "many nested definitions"] and (got[0].priority, got[0].automation) == (10, 1.0)
    assert (got[1].issues, got[1].priority, got[1].automation) == ([], 1, 0.0)


def test_importers_by_candidates(spark):
    files = spark.createDataFrame([("p/a.py", "p.a"), ("p/b.py", "p.b"), ("c.py", "c")], "file_path string, module string")
    imports = spark.createDataFrame([("p/b.py", "p.a"), ("c.py", "a"), ("p/a.py", "b")], "file_path string, target string")
    assert {r.file_path: r.importers for r in D.imports_by_candidates(files, imports).collect()} == {"p/a.py": ["p/b.py"], "p/b.py": ["p/a.py"], "c.py": None}


def test_views(spark, facts, tmp_path):
    _, a = facts
    found = audit.findings(a).cache()
    edges = extract.resolved(a.dependencies, a.symbols).cache()
    stats = {r.file_path: r for r in views.file_stats(a, found).collect()}
    assert len(stats) == a.files.count() and stats["pkg/lonely.py"].n_symbols == 1
    rel = {r.qualified_name: (r.n_out, r.n_in) for r in views.symbol_relationships(a, edges).collect()}
    assert rel["pkg.z.later"][1] == 2  # imported by one module, called by one method
    assert {r.name: r.n for r in views.counts(a).collect()}["errors"] == 1
    assert views.breakdowns(a).where("kind IS NULL AND semantic_category IS NULL").first().n == a.symbols.count()
    assert views.external_targets(a, edges, 3).count() == 3 and views.block_context(a).count() == a.blocks.count()
    assert ("pkg.a", "pkg.z.later", "imports") in {tuple(r) for r in views.dependency_edges(edges, a.symbols).collect()}
    assert views.clone_statistics(audit.clones(a)).count() >= 1 and views.duplicate_analysis(a).count() >= 0
    assert views.project_metrics(a).first().test_files == 1
    assert views.refactoring_candidates(found, a.files, 2).count() <= 2
    views.write_views({"counts": views.counts(a)}, str(tmp_path))
    views.compacted(spark, f"{tmp_path}/counts", f"{tmp_path}/small", 2)
    assert spark.read.parquet(f"{tmp_path}/small").count() == 6
    log = views.QueryLog(spark)
    assert log.run("c", views.counts(a)) == 6 and log.report().first().runs == 1
    pats = spark.createDataFrame([("x", 5, "a"), ("x", 9, "b"), ("y", 1, "c")], "advice string, savings int, target string")
    assert {r.advice: (r.n, r.savings, r.examples) for r in views.duplication_patterns(pats, 1).collect()} == {"x": (2, 14, ["b"]), "y": (1, 1, ["c"])}


def test_knowledge_and_settings(spark, tmp_path):
    items = [{"id": "1", "title": "God class", "category": "smell", "content": "Split it", "tags": ["oop"], "confidence": 0.9, "usage_count": 3}, {"id": "2", "title": "Other", "category": "smell", "content": "", "tags": None, "confidence": 0.5, "usage_count": 1}]
    (tmp_path / "k.json").write_text(json.dumps(items))
    k = knowledge.knowledge(spark, f"{tmp_path}/k.json")
    assert [r.id for r in knowledge.found(k, "SPLIT").collect()] == ["1"] and knowledge.statistics(k).first().uses == 4
    (tmp_path / "a.json").write_text(json.dumps({"findings": [{"finding_id": "f", "file_path": "a\\b.py", "severity": "low"}]}))
    assert knowledge.audit_findings(spark, f"{tmp_path}/a.json").first().file_path == "a/b.py"
    (tmp_path / "s.json").write_text('{"near_lines": 3, "exclude": ["x"]}')
    s = knowledge.Settings.load(f"{tmp_path}/s.json", {"QUARRYLENS_LEAST_CONFIDENCE": "0.7"})
    assert (s.near_lines, s.exclude, s.least_confidence) == (3, ("x",), 0.7)
    with pytest.raises(ValueError):
        (tmp_path / "t.json").write_text('{"nope": 1}')
        knowledge.Settings.load(f"{tmp_path}/t.json", {})
