"""Fact extraction, resolution, audit, history and streaming on small sources."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quarrylens.plans import audit, experts
from quarrylens.sources import code, extract, history
from quarrylens.streaming import incremental

FILES = {
    "pkg/__init__.py": "",
    "pkg/a.py": '''"""Doc."""
import os
from . import b
from pkg.z import later

try:
    import ujson
except ImportError:
    ujson = None
DEBUG = False


class A(b.Base):
    def run(self, items: list, limit=3):
        """Runs.

        Raises: ValueError
        """
        for x in items:
            if x > limit and x != 0:
                self.total = self.helper(x)
        if not items:
            raise ValueError("none")
        return self.total

    def helper(self, x):
        return os.path.join("a", x)

    @staticmethod
    def fixed():
        return later(1)

    def helper(self, y):
        return y


def dead(config):
    return config["k"] or config.get("k") or "k" in config
''',
    "pkg/b.py": "from pkg import c\n\n\nclass Base:\n    pass\n\n\nasync def go():\n    def inner():\n        return 1\n    return inner()\n",
    "pkg/c.py": "import pkg.a\n\n\ndef main():\n    for i in range(3):\n        for j in range(3):\n            print(i)\n    pkg.a.A().run([1])\n\n\nmain()\n",
    "pkg/z.py": "def later(n):\n    for i in range(3):\n        for j in range(3):\n            print(i)\n    return n\n",
    "pkg/lonely.py": "X = 1\n",
    "pkg/bad.py": "def broken(:\n",
    "pkg/größe.py": "# Kommentar\nß = 'ä'\n",
    "tests/test_a.py": "from pkg.a import A\n\n\ndef test_run():\n    assert A().run([1]) == 1\n    assert True\n",
    "venv/skipped.py": "x = 1\n",
    "notes.txt": "no source",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("project")
    for name, text in FILES.items():
        p = top / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(top)


@pytest.fixture(scope="module")
def facts(spark, root, tmp_path_factory):
    return audit.facts(spark, root, str(tmp_path_factory.mktemp("facts")))


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


def test_scan(spark, root):
    got = {r.file_path: r for r in code.files(spark, root).collect()}
    assert set(got) == {f for f in FILES if f.endswith(".py") and not f.startswith("venv/")}
    assert got["tests/test_a.py"].is_test_file and not got["pkg/a.py"].is_test_file
    assert set(names(code.files(spark, root, exclude=("^tests/",)), "file_path")) == set(got) - {"tests/test_a.py"}
    assert ("pkg/c.py", "pkg.a") in {tuple(r) for r in code.quick_imports(code.files(spark, root)).collect()}
    assert [r.line for r in code.call_sites(code.files(spark, root), ["later"]).orderBy("line").collect() if r.file_path == "pkg/a.py"] == [31]


def test_symbols(facts):
    got = {r.qualified_name: r for r in facts.symbols.collect()}
    assert got["pkg"].kind == "module" and got["pkg.a.A"].kind == "class" and got["pkg.a.A"].base_classes == ["b.Base"]
    assert got["pkg.a.A.run"].kind == "method" and got["pkg.a.A.run"].complexity_score == 5
    assert got["pkg.a.A.fixed"].is_static and got["pkg.b.go"].is_async and got["pkg.b.go.inner"].kind == "function"
    twice = facts.symbols.where("qualified_name = 'pkg.a.A.helper'").collect()
    assert len({r.symbol_uid for r in twice}) == 2
    assert facts.symbols.count() == facts.symbols.select("symbol_uid").distinct().count()


def test_errors_are_rows(facts):
    assert [(r.file_path, r.message.split(":")[0]) for r in facts.errors.collect()] == [("pkg/bad.py", "SyntaxError")]
    assert extract.extract("x.py", None)[0][0] == "errors" and extract.extract("x.py", "\0")[0][0] == "errors"


def test_dependencies_and_accesses(facts):
    deps = {(r.file_path, r.target_external, r.dependency_kind) for r in facts.dependencies.collect()}
    assert {("pkg/a.py", "pkg.b", "imports"), ("pkg/a.py", "pkg.z.later", "imports"), ("pkg/a.py", "os.path.join", "calls"), ("pkg/a.py", "b.Base", "inherits"), ("pkg/a.py", "self.helper", "calls")} <= deps
    inner = facts.symbols.where("name = 'go'").first().symbol_uid
    assert names(facts.dependencies.where(F.col("source_uid") == inner), "target_external") == ["inner"]
    assert ("total", "write") in {(r.attribute_name, r.access_type) for r in facts.accesses.collect()}
    counted = {(r.target_external): r.usage_count for r in extract.counted_dependencies(facts.dependencies.where("file_path = 'pkg/c.py'")).collect()}
    assert counted["range"] == 2


def test_blocks_and_fingerprints(facts):
    b = facts.blocks.where("file_path IN ('pkg/c.py', 'pkg/z.py')").orderBy("file_path", "line_start").collect()
    assert [(x.block_type, x.nesting_level) for x in b] == [("for", 1), ("for", 2)] * 2
    assert b[0].token_fingerprint == b[2].token_fingerprint and b[0].normalized_fingerprint == b[2].normalized_fingerprint
    assert extract.normalised([__import__("ast").parse("x = foo(1)").body[0]]) == extract.normalised([__import__("ast").parse("y = bar(2)").body[0]])


def test_resolution(facts):
    got = {(r.file_path, r.target_external): (r.target_uid, r.rule) for r in extract.resolved(facts.dependencies, facts.symbols).collect()}
    uid = {r.qualified_name: r.symbol_uid for r in facts.symbols.collect()}
    assert got["pkg/a.py", "pkg.z.later"] == (uid["pkg.z.later"], "qualified_name")  # a file sorted later
    assert got["pkg/a.py", "later"] == (uid["pkg.z.later"], "unique_name")
    assert got["pkg/c.py", "main"] == (uid["pkg.c.main"], "same_file")
    assert got["pkg/a.py", "os"] == (None, None) and got["pkg/a.py", "self.helper"][0] is None  # two of that name


def test_reachability_of_modules(facts):
    assert {"pkg/lonely.py", "pkg/größe.py", "pkg/__init__.py"} >= set(names(audit.unreachable(facts), "file_path")) >= {"pkg/lonely.py", "pkg/größe.py"}


def test_audit(facts):
    found = audit.findings(facts).cache()
    assert found.count() == found.select("finding_id").distinct().count()
    kinds = {(r.smell_type, r.target) for r in found.collect()}
    assert ("unused", "pkg.a.dead") in kinds and not any(t == "pkg.z.later" for k, t in kinds if k == "unused")
    assert {k for k, _ in kinds} >= {"unused", "clone_exact"}
    assert audit.statistics(found).agg(F.sum("n")).first()[0] == found.count()
    score = audit.health(found, facts.files).first()
    assert 0 < score.score <= 100 and score.n_files == 9
    assert {"score", "priority", "rank_score"} <= set(audit.decisions(facts, found).columns)
    assert audit.hotspots(found).where("size(examples) > 5").count() == 0
    edges = audit.file_graph(facts)
    assert {(r.from_file, r.to_file) for r in edges.collect()} >= {("pkg/a.py", "pkg/z.py"), ("pkg/c.py", "pkg/a.py")}
    assert {r.neighbor for r in audit.neighbors(edges, "pkg/a.py").collect()} >= {"pkg/b.py", "pkg/z.py", "pkg/c.py"}
    assert [r.step for r in audit.refactoring_path(found).orderBy("step").collect()][0] == 1
    none = audit.health(found.limit(0), facts.files.limit(0)).first()
    assert none.score == 100 and none.penalty == 0


def test_experts(spark, facts, root):
    scan = code.files(spark, root)
    details = extract.table_of(extract.facts(scan), "details").cache()
    assert {r.name for r in details.where("detail = 'optional_import'").collect()} == {"ujson"}
    uid = {r.qualified_name: r.symbol_uid for r in facts.symbols.collect()}
    keys = {r.key: (r.n, r.safe, r.critical) for r in experts.key_usage(details).collect()}
    assert keys == {"k": (3, 2, False)}
    ex = {r.qualified_name: r.safety for r in experts.exception_contracts(facts, details).collect()}
    assert ex["pkg.a.A.run"] == "moderate" and ex["pkg.a.dead"] == "safe"
    assert experts.contracts(details).where(F.col("symbol_uid") == uid["pkg.a.A.run"]).count() == 2
    cases = experts.characterisation_cases(details).where(F.col("symbol_uid") == uid["pkg.a.A.run"])
    assert {(r.case, r.parameter) for r in cases.collect()} == {("typical", None), ("edge", "items"), ("error", "items"), ("error", "limit")}
    tests = {r.name: r.tested for r in experts.test_coverage(facts, scan.where("is_test_file")).collect()}
    assert tests["run"] and not tests["dead"]
    quality = experts.test_quality(facts, details).first()
    # two assertions, one of them trivial: 50 + 12 - 20 and 50 + 12 - 30
    assert (quality.asserts, quality.trivial, quality.quality, quality.signal, quality.band) == (2, True, 42, 32, "low")
    assert {r.name for r in experts.optional_dependencies(details).collect()} == {"ujson", "DEBUG"}
    graph = {r.node: r for r in experts.call_graph(facts).collect()}
    assert graph[uid["pkg.c.main"]].fan_in == 1
    level = {(r.file_path, r.module): (r.kind, r.level) for r in experts.imports_classified(facts, ("os",)).collect()}
    assert level["pkg/a.py", "os"] == ("standard", "normal") and level["pkg/b.py", "pkg.c"] == ("internal", "unused")
    assert experts.cohesion_matrix(facts).where("share > 1").count() == 0
    assert experts.callers(facts, "pkg/z.py").count() >= 1 and experts.propagation(facts).count() >= 1
    assert experts.golden_traces(facts).where("file_path = 'pkg/c.py'").count() == 2
    assert experts.argument_patterns(details).count() >= 1 and experts.workflow(facts).count() >= 1
    assert experts.compatibility(facts, facts).count() == 0


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "k string, h string")
    assert sorted(map(tuple, code.changes(old, new, "k", "h").collect())) == [("b", "changed"), ("c", "removed"), ("d", "added")]


def test_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for k in range(3):
        for f in ("a.py", "b.py") if k < 2 else ("c.py",):
            (tmp_path / f).write_text(f"x = {k}\n")
        git("add", ".")
        git("commit", "-qm", f"c{k}")
    log = history.log(spark, str(tmp_path))
    assert sorted(map(tuple, history.co_changes(log).collect())) == [("a.py", "b.py", 2)]
    assert history.velocity(log).agg(F.sum("commits")).first()[0] == 3


def test_incremental_index(spark, tmp_path):
    src, target, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    (src / "a.py").write_text("def one():\n    pass\n")
    (src / "b.py").write_text("def two():\n    pass\n")
    incremental.index(spark, str(src), target, mark).awaitTermination()
    assert names(incremental.current(spark, target, "symbols").where("kind = 'function'")) == ["one", "two"]
    (src / "c.py").write_text("def three():\n    pass\n")
    incremental.index(spark, str(src), target, mark).awaitTermination()
    assert names(incremental.current(spark, target, "symbols").where("kind = 'function'")) == ["one", "three", "two"]


def test_update_sees_old_times_and_deletions(spark, tmp_path):
    src, target = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for k in range(5):
        (src / f"f{k}.py").write_text(f"def f{k}():\n    pass\n")
    told = []
    assert incremental.update(spark, str(src), target, 2, lambda done, n: told.append((done, n))) == {"added": 5} and told[-1] == (5, 5) and len(told) == 3
    functions = lambda: names(incremental.current(spark, target, "symbols").where("kind = 'function'"))
    assert functions() == [f"f{k}" for k in range(5)]
    (src / "f0.py").write_text("def g0():\n    pass\n")
    (src / "f1.py").unlink()
    (src / "old.py").write_text("def old():\n    pass\n")
    os.utime(src / "old.py", (1, 1))
    assert incremental.update(spark, str(src), target) == {"added": 1, "changed": 1, "removed": 1}
    assert functions() == ["f2", "f3", "f4", "g0", "old"] and incremental.update(spark, str(src), target) == {}
    (src / "f1.py").write_text("def f1():\n    pass\n")
    assert incremental.update(spark, str(src), target) == {"added": 1} and "f1" in functions()


def test_discovery(spark, tmp_path):
    for p in ("a.py", "b.pyi", ".hidden.py", "build/c.py", "lib/d.py", "lib/e.pyc"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    found = lambda **k: [r.file_path for r in code.discovered(spark, str(tmp_path), **k).collect()]
    assert found() == ["a.py", "lib/d.py"] and found(include=("*.py", "*.pyi", "a*")) == ["a.py", "b.pyi", "lib/d.py"]
    assert {r.file_path for r in code.hashes(code.files(spark, str(tmp_path))).collect()} == {"a.py", ".hidden.py", "build/c.py", "lib/d.py"}


SHAPES = '''
class Box:
    size = 0

    def get(self, other):
        self.size = other.a.b.size + self.size
        x = Thing(1)
        if other:
            y = Thing(2)
            z = Thing(3)
        else:
            y = Thing(4)
            z = None
        with Lock() as lock:
            w = [i for i in range(3) if i if i > 1]
        match x:
            case 1:
                return 1 if y else 2
            case _:
                pass
        return other._hidden
'''


def test_metrics_of_methods(spark):
    rows = extract.extract("m.py", SHAPES)
    get = next(r for t, r in rows if t == "symbols" and r["name"] == "get")
    # if 1, the comprehension 1 with two conditions, two cases, a conditional expression
    assert (get["complexity_score"], get["smell_complexity"], get["nesting_depth"], get["statement_count"]) == (2, 8, 1, 13)
    assert get["structure"].startswith("FunctionDef(2,Assign,Assign,If(Assign,Assign,Assign,Assign),With(Assign),Match,Return)")
    hints = {r["name"]: r["value"] for t, r in rows if t == "details" and r["detail"] == "type_hint"}
    assert hints == {"x": "Thing", "y": "Thing", "lock": "Lock"}
    uses = [(r["attribute_name"], r["receiver"], r["root"], r["outermost"]) for t, r in rows if t == "attribute_access"]
    assert sorted(uses, key=str) == sorted([("size", "self", "self", True), ("size", None, "other", True), ("b", None, "other", False), ("a", "other", "other", False), ("size", "self", "self", True), ("_hidden", "other", "other", True)], key=str)


def test_event_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = incremental.event_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("counts").collect()))
    assert got == sorted(map(tuple, incremental.event_counts(events).collect())) and got
    assert incremental.sessions(events).agg(F.sum("n")).first()[0] == events.count()
    m = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "k int, c string")
    assert incremental.affected(m, m.where("k = 2"), "c", "k").count() == 2
