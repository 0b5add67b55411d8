"""Operators on small frames with known results: nulls, blanks, ties, empties."""

import difflib
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylens import schemas, sinks
from quarrylens import values as V
from quarrylens.functions import scalar as S
from quarrylens.operators import aggregates as A
from quarrylens.operators import graph as G
from quarrylens.operators import joins as J
from quarrylens.operators import lookups as L
from quarrylens.operators import methods as M
from quarrylens.operators import rules as R
from quarrylens.operators import similarity as C
from quarrylens.plans import star_shapes  # noqa: F401
from quarrylens.plans.extensions import Registry, steps_of
from quarrylens.plans.registry import QUERIES


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_search_takes_wildcards_literally(spark):
    df = frame(spark, [("a_b", 1), ("axb", 2), ("A_B%", 3), (None, 4)], "name string, k int")
    assert [r.k for r in L.search(df, "a_b", ["name"]).orderBy("k").collect()] == [1, 3]
    assert [r.k for r in L.search(df, "%", ["name"]).collect()] == [3]


def test_columns_are_allow_listed(spark):
    with pytest.raises(ValueError):
        L.chosen_columns(frame(spark, [(1,)], "a int"), ["a; drop"], {"a"})


def test_top_k_breaks_ties(spark):
    df = frame(spark, [(1, 5), (2, 5), (3, 5)], "k int, v int")
    assert [r.k for r in L.top_k(df, 2, F.desc("v"), "k").collect()] == [1, 2]


def test_violations_count_nulls(spark):
    df = frame(spark, [(1, "a"), (None, "b"), (3, "a")], "v int, s string")
    got = {r.rule: (r.checked, r.broken) for r in L.violations(df, {"v": F.col("v") > 1, "s": F.col("s") == "a"}).collect()}
    assert got == {"v": (3, 2), "s": (3, 1)}


def test_groups_skip_blank_and_null(spark):
    df = frame(spark, [("x", 1), ("x", 2), ("", 3), ("", 4), (None, 5), (None, 6), ("y", 7)], "fp string, k int")
    assert rows(A.repeated_groups(df, "fp", "k")) == [("x", 2, [1, 2])]
    assert A.repeated_groups(df.limit(0), "fp", "k").count() == 0


def test_representatives_keep_every_link(spark):
    df = frame(spark, [("x", 3), ("x", 1), ("x", 2), (None, 9), (None, 8)], "h string, k int")
    assert rows(J.representative_pairs(df, "h", "k").select("first_member", "k")) == [(1, 2), (1, 3)]


def test_longest_prefix_needs_a_unique_module(spark):
    names = frame(spark, [("a.b.c.d",), ("a.x",), ("z",), (None,)], "name string")
    known = frame(spark, [("a.b", 1), ("a", 2), ("a.b.c", 3), ("a.b.c", 4)], "prefix string, id int")
    got = {r.name: r.id for r in J.longest_prefix(names, "name", known, "prefix", "id", ".", 6).collect()}
    assert got == {"a.b.c.d": 1, "a.x": 2, "z": None, None: None}
    assert {r.name: r.id for r in J.longest_prefix(names, "name", known, "prefix", "id", ".", 1).collect()}["a.b.c.d"] is None


def test_cascade_first_rule_wins(spark):
    df = frame(spark, [(1,), (2,), (3,)], "k int")
    a, b = frame(spark, [(1, 10)], "k int, v int"), frame(spark, [(1, 20), (2, 21)], "k int, v int")
    assert rows(J.cascade(df, "k", [("a", a), ("b", b)], "v").select("k", "v", "rule")) == [(1, 10, "a"), (2, 21, "b"), (3, None, None)]


def test_overlapping_findings(spark):
    f = frame(spark, [("f", "a", "t", 1, 5), ("f", "b", "t", 5, 9), ("f", "c", "u", 19, 19), ("f", "d", "u", 30, 30), ("g", "e", "t", 1, 300), ("g", "h", "v", 290, 290)], "file_path string, finding_id string, finding_type string, line_start int, line_end int")
    assert rows(J.overlapping(f).select("a", "b")) == [("a", "b"), ("e", "h")]
    ten = frame(spark, [("f", "a", "t", 1, 1), ("f", "b", "t", 11, 11), ("f", "c", "t", 22, 22)], f.schema)
    assert rows(J.overlapping(ten).select("a", "b")) == [("a", "b")]
    assert rows(J.same_type_groups(f).select("file_path", "finding_type", "n")) == [("f", "t", 2), ("f", "u", 2)]


def test_blocked_pairs_leave_out_large_blocks(spark):
    df = frame(spark, [(1, ["a", "x"]), (2, ["a", "x"]), (3, ["x"]), (4, [])], "k int, b array<string>")
    assert rows(J.blocked_pairs(df, "k", F.col("b"), 2)) == [(1, 2)]


def test_similar_sets_equal_brute_force(spark, tmp_path):
    rng = random.Random(7)
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    texts = [None, "", "12 !", "one", "One.", "one two three", "one two three four"]
    long = [word(rng.randrange(10**6)) for _ in range(400)]
    texts += [" ".join(long)] * 25 + [" ".join(long[k : k + 300]) for k in range(0, 100, 4)]  # every word held by more than 20, texts of over 700 characters
    for n in (4, 10, 17, 60):
        core = [word(rng.randrange(300)) for _ in range(n)]
        texts += [" ".join(w if rng.random() < 0.9 else word(rng.randrange(300)) for w in core) for _ in range(30)]
    texts += [" ".join(word(k) for k in range(100, 100 + n)) for n in (70, 71, 84, 99, 100, 120, 121, 143, 144)]  # borderline
    sets = [set(re.findall("[a-z]+", (t or "").lower())) for t in texts]
    first, want = {}, {}
    for k, s in enumerate(sets):
        if s and first.setdefault(frozenset(s), k) != k:
            want[first[frozenset(s)], k] = 1.0
    for x, a in first.items():
        for y, b in first.items():
            if a < b and 10 * len(x & y) >= 7 * len(x | y):
                want[a, b] = len(x & y) / len(x | y)
    frame(spark, list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["near_dup_jaccard"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) > 500 and {(r.a, r.b): r.similarity for r in got} == want
    none = frame(spark, [], "k int, b array<string>")
    assert J.similar_sets(none, "k", F.col("b"), 7).count() == 0


def test_suffix_join_takes_the_longest(spark):
    a = frame(spark, [("C:\\p\\src\\m.py",), ("/q/m.py",), ("/q/n.py",)], "path string")
    r = frame(spark, [("src/m.py",), ("m.py",)], "rel string")
    assert {x.path: x.rel for x in J.suffix_join(a, r, "path", "rel").collect()} == {"C:\\p\\src\\m.py": "src/m.py", "/q/m.py": "m.py", "/q/n.py": None}


def test_nested_members(spark):
    outer, inner = frame(spark, [(1, "m.A")], "file_id int, qn string"), frame(spark, [(1, "m.A.f"), (1, "m.A.B.g"), (1, "m.Ax.f"), (2, "m.A.f")], "file_id int, iqn string")
    assert sorted(r.iqn for r in J.nested_members(outer, inner, "file_id", "qn", "iqn").collect()) == ["m.A.B.g", "m.A.f"]


def test_fan_and_usage(spark):
    e = frame(spark, [(1, 2), (1, 2), (3, 2), (2, 1)], "s int, t int")
    assert rows(G.degrees(e, "s", "t")) == [(1, 1, 1), (2, 1, 2), (3, 1, 0)]
    assert rows(J.used_flags(frame(spark, [(1,), (5,)], "k int"), e, "k", "t")) == [(1, True), (5, False)]


def test_reachability_and_depth(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("b", None)], "s string, t string")
    start = frame(spark, [("a",)], "n string")
    assert rows(G.reachable(e, start, "s", "t")) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(G.reachable(e, start, "s", "t", 1)) == [("a", 0), ("b", 1)]


def test_cycles_and_longest_path(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d")], "s string, t string")
    assert sorted("".join(r.path) for r in G.cycles(e, "s", "t").collect()) == ["ab", "abc", "d"]
    assert G.longest_path(e, "s", "t") == 4  # a, b, c and a again


def test_longest_chain(spark):
    depth = lambda *e: G.longest_path(frame(spark, list(e), "a string, b string"), "a", "b")

    def brute(*e):
        out = {}
        for a, b in e:
            out.setdefault(a, []).append(b)
            out.setdefault(b, [])

        def walk(node, d, on):
            return d if node in on else max([d, *(walk(n, d + 1, on | {node}) for n in out[node])])

        return max((walk(n, 1, frozenset()) for n in out), default=0)

    rng = random.Random(3)
    for graph in ([("a", "b"), ("b", "c"), ("a", "c")], [("a", "b"), ("b", "a")], [("a", "a")], [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e")], sorted({(str(rng.randrange(7)), str(rng.randrange(7))) for _ in range(9)})):
        assert depth(*graph) == brute(*graph)
    assert G.longest_path(frame(spark, [], "a string, b string"), "a", "b") == 0
    chain = [(f"n{k:02}", f"n{k + 1:02}") for k in range(25)]
    assert depth(*chain) == 26


def test_components(spark):
    e = frame(spark, [(5, 4), (4, 3), (9, 8), (3, 2), (2, 1), (None, 1)], "a int, b int")
    assert rows(G.components(e, "a", "b")) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)]


def test_jaccard_conventions(spark):
    df = frame(spark, [([], []), (["a"], []), (["a", "a", "b"], ["b"])], "a array<string>, b array<string>")
    got = df.select(S.jaccard("a", "b").alias("one"), S.jaccard("a", "b", 0.0).alias("zero"), S.jaccard("a", "b", None).alias("none")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0, None), (0.0, 0.0, 0.0), (0.5, 0.5, 0.5)]


def test_scalars(spark):
    df = frame(spark, [("a/b/__init__.py", "https://x.y/z", "(a, b)", 0.125), ("m.py", "1.2.3", "()", 2.5)], "p string, l string, s string, x double")
    got = df.select(S.module_name("p").alias("m"), S.literal_class(F.col("l")).alias("c"), S.signature_arity("s").alias("n"), S.half_even("x", 2).alias("r")).collect()
    assert [tuple(r) for r in got] == [("a.b", "url", 2, 0.12), ("m", "version", 0, 2.5)]
    one = df.limit(1).select(S.blake2b_64(F.lit("x")).alias("b"), S.fuzzy_ratio(F.lit("abcd"), F.lit("bcde")).alias("f"), S.normalised_source(F.lit("x = foo('a', 1)\n# c\ny = x")).alias("n")).first()
    assert len(one.b) == 16 and one.f == 0.75 and one.n == "VAR_0 = VAR_1(STRING_LITERAL, NUMBER_LITERAL)\n# VAR_2\nVAR_3 = VAR_0"


def test_dedup_fingerprints(spark):
    rows = [("a = f(1)\nb = 2", "Assign"), ("a  =  f( 1 )\n\nb = 2", "Assign"), ("x = g(7)\ny = 3", "Assign"), ("x", "Expr(Name)"), (None, None)]
    got = [r.f for r in frame(spark, rows, "s string, t string").select(S.dedup_fingerprints("s", "t").alias("f")).collect()]
    assert got[0].exact == got[1].exact != got[2].exact and got[0].normalized == got[2].normalized != got[1].normalized and got[0].structural == got[2].structural != got[3].structural
    assert got[3].exact == hashlib.blake2b(b"x", digest_size=8).hexdigest() and got[4].exact is None
    assert frame(spark, [("# c\n\n  x = 1\n\t# d\ny",)], "s string").select(S.code_lines(F.col("s"))).first()[0] == 2


def blocks(spark):
    schema = "block_uid string, file_path string, line_start int, line_end int, block_type string, token_fingerprint string, ast_fingerprint string, normalized_fingerprint string, lines_of_code int, nesting_level int, statement_count int"
    rows = [("a", 1, "t", "s", "n", 10, 1, 5), ("b", 2, "t", "s", "n", 10, 1, 5), ("c", 2, "t", "s", "n", 10, 1, 5), ("d", 1, "u", "s2", "n2", 3, 1, 2), ("e", 1, "v", "s2", "n2", 3, 1, 2), ("f", 1, "w", "s3", "", 3, 1, 2), ("g", 1, "x", "s3", None, 3, 1, 2), ("h", 1, "", "", "", 3, 1, 2), ("i", 1, None, None, None, 3, 1, 2), ("j", 1, "t", "s", "n", 2, 1, 5)]
    return frame(spark, [(k, f"f{p}.py", 1, n, "if", t, s, m, n, d, b) for k, p, t, s, m, n, d, b in rows], schema)


def test_clone_passes_cover(spark):
    g = C.clone_groups(blocks(spark))
    assert rows(g.select("clone_type", "members", "similarity")) == [("exact", ["a", "b", "c"], 1.0), ("hybrid", ["d", "e"], 0.95), ("structural", ["f", "g"], 0.9)]
    ids = {r.clone_type: r.group_id for r in g.collect()}
    assert ids["exact"] == "exact_" + hashlib.blake2b(b"exact|exact|a|b|c", digest_size=16).hexdigest()
    assert ids["hybrid"] == "hybrid_" + hashlib.blake2b(b"hybrid|normalized,structural|d|e", digest_size=16).hexdigest()
    ranked = C.ranked_clones(g, blocks(spark))
    r = ranked.collect()
    # feasibility .5 + .2 + .2 + .1 + .05, capped at 1; confidence min(.95, 1 + .15)
    assert [x.members for x in r] == [["a", "b", "c"]] and r[0].strategy == "extract_method" and r[0].extraction_confidence == 0.95 and r[0].feasible == 1.0
    assert r[0].ranking == pytest.approx(1.0 * 0.3 + 0.3 * 0.2 + 0.5 * 0.2 + 0.95 * 0.2 + 0.1) and r[0].representative == "a"
    every = {x.clone_type: x for x in C.ranked_clones(g, blocks(spark), cut=0.0).collect()}
    assert every["hybrid"].strategy == "no_extraction" and every["hybrid"].ranking == pytest.approx((0.95 * 0.3 + 0.2 * 0.2 + 0.15 * 0.2) * 0.95)
    shown = C.clone_summary(ranked, blocks(spark), preview=2).first()
    assert shown.preview == ["f1.py:1-10", "f2.py:1-10"] and shown.total_lines == 30
    assert C.clone_evidence(ranked).first().description == "Exact clone group with 3 instances"


def test_winnowing(spark):
    df = frame(spark, [(["d", "b", "c", "a", "e", "f"],), (["z", "y"],), ([],)], "h array<string>")
    assert [r[0] for r in df.select(C.winnowed(F.col("h"))).collect()] == [["a"], ["y", "z"], []]
    assert frame(spark, [("a b c d",)], "s string").select(C.kgrams(F.split("s", " "), 3)).first()[0] == ["a b c", "b c d"]


def test_cluster_mean_counts_missing_pairs(spark):
    m = frame(spark, [("c", 1), ("c", 2), ("c", 3), ("d", 4)], "cluster string, k int")
    p = frame(spark, [(1, 2, 0.9), (1, 4, 0.9)], "a int, b int, similarity double")
    got = {r.cluster: r.mean_similarity for r in C.cluster_means(m, p, "cluster", "k").collect()}
    assert got == {"c": pytest.approx(0.3), "d": 1.0}


def test_greedy_windows(spark):
    df = frame(spark, [("f", 1, 10, 5), ("f", 8, 12, 9), ("f", 20, 22, 1), ("g", 1, 2, 1)], "scope string, start long, end long, savings long")
    assert {tuple(r) for r in C.greedy_windows(df, "scope").select("scope", "start").collect()} == {("f", 8), ("f", 20), ("g", 1)}


def test_channel_similarity(spark):
    names = ("ast", "token", "signature", "name"), ("calls", "imports", "globals", "inputs", "outputs", "literals")
    cols = ", ".join(f"{s}_{c} string" for c in names[0] for s in "ab") + ", " + ", ".join(f"{s}_{c} array<string>" for c in names[1] for s in "ab")
    none = [[]] * 12
    rows = [
        ("x", "x", "t", "t", "f(a, b) -> int", "f(a, b) -> int", "f", "f", *([["d"]] * 12)),
        ("", "", "", "", "", "", "get_x", "get_x", *none),
        ("x", "y", "", "", "f(a)", "f(a, b)", "load_data", "loadData", ["p", "q"], ["q"], *none[2:10], ["hello world"], ["hello there"]),
    ]
    got = [r.similarity for r in C.channel_similarity(frame(spark, rows, cols)).collect()]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    third = 0.3 * 0.0 + 0.2 * (0.5 + 0) / 2 + 0.15 * (1 + 1 + (0.9 + 0.5 + 1) / 3) / 3 + 0.15 * 0.5 + 0.1 * ratio("hello world", "hello there") + 0.1 * (1 + ratio("load_data", "loaddata")) / 2
    assert got == [pytest.approx(1.0), pytest.approx(0.2), pytest.approx(third)]


def test_safe_exact(spark):
    cols = "cluster string, callable_kind string, method_name string, decorator_kind string, signature_shape string, free_names string, fingerprint string"
    df = frame(spark, [("c", "f", "n", None, "s", "", "p"), ("c", "f", "n", None, "s", "", "p"), ("d", "f", "n", None, "s", "", "p"), ("d", "f", "n", None, "s2", "", "q")], cols)
    assert rows(C.safe_exact(df, "cluster")) == [("c", "SAFE_EXACT"), ("d", "different signatures")]


def test_cohesion(spark):
    a = frame(spark, [("A", "f", "x"), ("A", "g", "x"), ("A", "h", "y"), ("B", "f", None), ("B", "g", None), ("C", "f", "x")], "scope string, m string, attr string")
    assert {r.scope: r.cohesion for r in R.cohesion(a, "scope", "m", "attr").collect()} == {"A": pytest.approx(1 / 3), "B": 0.0, "C": 1.0}


def test_cohesion_of_null_classes_and_methods(spark):
    """As in SQL: null is equal to no class, and not counted as a method."""
    a = frame(spark, [(None, "f", "x"), (None, "g", "x"), ("A", None, "x"), ("A", "f", "x"), ("A", "g", "y"), ("B", None, "x")], "scope string, m string, attr string")
    assert rows(R.cohesion(a, "scope", "m", "attr")) == [("A", 2, 0, 0.0), ("B", 0, 0, 1.0), (None, 2, 0, 0.0)]


def _pairs_sharing(access):
    """Brute force: class to (methods, pairs that share an attribute)."""
    held = {}
    for scope, m, attr in access:
        held.setdefault(scope, {}).setdefault(m, set()).add(attr)
    return {k: (len(v), sum(1 for x, y in itertools.combinations([s - {None} for s in v.values()], 2) if x & y)) for k, v in held.items()}


@pytest.mark.parametrize("kind", ["string", "long"])
def test_cohesion_common_and_rare_attributes(spark, monkeypatch, kind):
    """Dense and sparse sets, copies, sets of rare attributes only, more than 64
    common attributes, several blocks."""
    monkeypatch.setattr(R, "BLOCK_SETS", 40)
    monkeypatch.setattr(R, "PAIRS", 100)
    rng, value = random.Random(5), str if kind == "string" else int
    access = []
    for m in range(300):
        access += [("dense", m, x) for x in rng.sample(range(70), rng.choice([1, 2, 3, 60]))]
        access += [("wide", m % 150 + 1000 * (m // 150), x) for x in (rng.sample(range(150), 40) if m < 150 else [200 + m % 150 // 2])]
        access += [("sparse", m, x) for x in rng.sample(range(900), 2)] + [("sparse", m, 1000)] * (m % 5 == 0)
        access += [("copies", m, x) for x in ((m % 50, 77) if m % 2 else (m % 50,))]
    access += [("none", m, None) for m in range(3)] + [("dense", 999, None)]
    df = frame(spark, [(s, m, None if x is None else value(x)) for s, m, x in access], f"scope string, m long, attr {kind}")
    got = {r.scope: (r.n, r.shared) for r in R.cohesion(df, "scope", "m", "attr").collect()}
    assert got == _pairs_sharing(access)


def _most_rows(node) -> int:
    """The most rows that an operator of a plan has put out."""
    name = node.getClass().getSimpleName()
    inner = [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.plan()] if name.endswith("QueryStageExec") else []
    kids = node.children()
    made = node.metrics().get("numOutputRows")
    return max([made.get().value() if made.isDefined() else 0, *map(_most_rows, inner), *(_most_rows(kids.apply(k)) for k in range(kids.size()))])


def test_cohesion_makes_no_rows_of_pairs(spark):
    """600 methods with different sets over 40 attributes: six million pairs by attribute."""
    rng = random.Random(6)
    access = [("A", m, x) for m in range(600) for x in rng.sample(range(40), 20)]
    df = R.cohesion(frame(spark, access, "scope string, m long, attr long"), "scope", "m", "attr")
    assert [(r.n, r.shared) for r in df.collect()] == [_pairs_sharing(access)["A"]]
    assert _most_rows(df._jdf.queryExecution().executedPlan()) <= 2 * len(access)


def test_god_class_bounds(spark):
    df = frame(spark, [("a", 16, 4, 0.4, 201), ("b", 15, 3, 0.5, 200), ("c", 16, 1, 1.0, 10)], "k string, method_count int, responsibility_count int, cohesion double, lines int")
    assert rows(R.god_class(df).select("k", "points", "severity")) == [("a", 3, "high"), ("c", 1, "low")]
    more = frame(spark, [("d", 31, 7, 0.2, 1), ("e", 1, 1, 1.0, 201)], df.schema)
    assert [(r.k, r.points, r.severity, round(r.confidence, 3)) for r in R.god_class(more).collect()] == [("d", 6, "critical", 1.0), ("e", 0, "low", 0.3)]


def test_smell_points(spark):
    m = frame(spark, [("a", 61, 21, 5, 7, 10, 10, True), ("b", 31, 1, 21, 1, 3, 2, False), ("c", 30, 20, 10, 4, 2, 2, True)], "k string, lines int, statements int, complexity int, nesting int, accesses int, external_accesses int, in_class boolean")
    got = {(r.k, r.smell_type): (r.severity, round(r.confidence, 3)) for r in R.method_smells(m).collect()}
    assert got == {("a", "long_method"): ("high", 1.0), ("a", "high_complexity"): ("medium", 1.0), ("a", "feature_envy"): ("high", 1.0), ("b", "long_method"): ("low", 0.65), ("b", "high_complexity"): ("medium", 1.0)}
    c = frame(spark, [("a", 7, 6, 7, 8), ("b", 4, 0, 4, 10), ("c", 1, 6, 4, 4), ("d", 3, 5, 3, 3)], "k string, responsibility_count int, external_dependencies int, private_accesses int, foreign_accesses int")
    got = {(r.k, r.smell_type): (r.severity, round(r.confidence, 3)) for r in R.class_smells(c).collect()}
    assert got == {("a", "srp_violation"): ("high", 1.0), ("a", "inappropriate_intimacy"): ("high", 1.0), ("b", "srp_violation"): ("medium", 0.8), ("c", "srp_violation"): ("low", 0.5), ("c", "inappropriate_intimacy"): ("low", 0.7)}


def test_words_of_names_and_contexts(spark):
    df = frame(spark, [("testGet",), ("reset",), ("do_it",), ("parse_db",)], "n string")
    assert [r[0] for r in df.select(R.name_category(F.col("n"))).collect()] == ["validation", "access", "business_logic", "transformation"]
    duty = df.select(R.responsibility(F.lit("load_x"))[0].alias("a"), R.responsibility(F.lit("load_x"))[1].alias("b"), R.responsibility(F.lit("reload"))[1].alias("c"), R.responsibility(F.lit("zzz"))[0].alias("d")).first()
    assert tuple(duty) == ("data", 0.8, 0.6, None)
    none = F.array().cast("array<string>")
    one = df.limit(1).select(
        R.has_context(F.array(F.lit("Redis.client")), none, none, V.PERSISTENCE).alias("a"), R.has_context(none, F.array(F.lit("x.loads")), none, V.SERIALIZATION).alias("b"), R.has_telemetry(F.array(F.lit("self.logger.info"))).alias("c"),
        R.has_telemetry(F.array(F.lit("informal"))).alias("d"), R.likely_regex(F.lit("a(b)c")).alias("e"), R.likely_regex(F.lit("abc")).alias("f"), R.literal_category(F.array(F.lit("zz"), F.lit("get where"))).alias("g"),
        R.literal_category(F.array(F.lit("Bearer x"))).alias("h"), R.tags(F.lit(60), F.lit(1), F.lit("_test_old"), F.lit("pkg.cli"), F.lit(True), F.lit(6)).alias("t"),
    ).first()
    assert tuple(one[:6]) == (True, True, True, False, True, False) and tuple(one.g) == ("persistence", "sql") and tuple(one.h) == ("security", "token")
    assert one.t == ["cli", "hotpath", "large", "legacy", "method", "private", "simple", "test"]


def test_dynamic_signs(spark):
    files = frame(spark, [("p/a.py", "x = getattr(a, 'b')\nm = importlib.import_module('q.r')\n"), ("p/b.py", "eval('1')" * 60), ("p/c.py", "pass")], "file_path string, content string")
    signs = R.dynamic_uses(files, "file_path", "content")
    assert signs.where("file_path = 'p/b.py'").count() == 50 and rows(signs.where("module IS NOT NULL").select("file_path", "module")) == [("p/a.py", "q.r")]
    assert rows(R.dynamic_findings(signs, "file_path").select("symbol_name", "confidence", "n_imports")) == [("dynamic_import_a.py", 0.4, 1), ("dynamic_usage_b.py", 0.3, 0)]


def test_unused_by_bare_name(spark):
    s = frame(spark, [("f", 1, True, False, False), ("g", 1, True, False, True), ("h", 1, False, True, True), ("k", 1, False, False, False)], "name string, file_id int, is_public boolean, dynamic_import boolean, dynamic boolean")
    u = frame(spark, [("f", 2), ("k", 1)], "name string, file_id int")
    assert {r.name: round(r.confidence, 2) for r in R.unused_symbols(s, u, 0.0).collect()} == {"g": 0.42, "h": 0.32, "k": 0.8}
    assert [(r.name, r.unused_type, r.severity) for r in R.unused_symbols(s, u).collect()] == [("k", "private_method_unused", "medium")]
    more = s.withColumn("exported", F.col("name") == "h")
    assert {r.name for r in R.unused_symbols(more, u, 0.0, library=True).collect()} == {"k"}


def test_priorities(spark):
    df = frame(spark, [(0.95, 0.9, 0.9), (0.7, 0.4, 0.7), (0.5, 0.9, 0.5), (0.1, 0.9, 0.1)], "score double, confidence double, impact double")
    assert [r[0] for r in df.select(R.priority_bucket(F.col("score"), F.col("confidence"), F.col("impact"))).collect()] == ["critical", "deferred", "medium", "low"]
    clones = frame(spark, [("g1", "exact", "extract_function", 0.9, 1.0, 4), ("g2", "semantic", "no_extraction", 0.0, 0.85, 2), ("g3", "structural", "parameterize", 0.6, 0.9, 9)], "group_id string, clone_type string, strategy string, extraction_confidence double, similarity double, group_size int")
    smells = frame(spark, [("A", "god_class", "critical", 0.9), ("f", "long_method", "low", 0.9), ("B", "other", "high", None)], "target string, smell_type string, severity string, confidence double")
    dead = frame(spark, [("x", 0.85), ("y", 0.6)], "target string, confidence double")
    got = {r.target: r for r in R.clone_decisions(clones).unionByName(R.smell_decisions(smells)).unionByName(R.unused_decisions(dead)).collect()}
    assert set(got) == {"g1", "g3", "A", "f", "B", "x"} and got["g1"].decision_type == "extract_method" and got["g3"].decision_type == "parameterize_duplicates"
    assert (got["A"].decision_type, got["A"].impact, got["A"].effort, got["A"].risk, got["A"].hours) == ("decompose_god_class", 0.9, 0.8, 0.5, 6.4) and (got["B"].decision_type, got["B"].confidence) == ("improve_cohesion", 0.7)
    ranked = R.decisions(clones, smells, dead).collect()
    assert [r.target for r in ranked] == ["A", "g1", "x", "B"]  # g3 takes too much effort, f has too little impact
    assert ranked[0].score == pytest.approx((0.9 * 0.3 + 0.5 * 0.15 + 0.2 * 0.1) * 0.9) and ranked[0].rank_score == pytest.approx(0.9 * 0.9 * (1 - 0.15)) and ranked[0].priority == "low"
    assert R.criteria() == V.CRITERIA and sum(R.criteria(risk=1.0).values()) == pytest.approx(1.0)


def test_quality_score_and_steps(spark):
    df = frame(spark, [(True, False, "MERGE"), (True, True, "KEEP_SEPARATE")], "a boolean, b boolean, recommendation string")
    assert [r[0] for r in df.select(R.quality_score({"a": 3.0, "b": 1.0})).collect()] == [3.0, 4.0]
    assert sum(V.COMPONENT_WEIGHTS.values()) == 100.0
    assert R.steps(df).count() == 4


def test_method_groups(spark):
    words = frame(spark, [("load", "read", 1.0), ("load", "get", 1.0), ("show", "print", 2.0)], "duty string, word string, weight double")
    m = frame(spark, [(1, "read_get_print"), (2, "other")], "k int, name string")
    assert {r.k: r.duty for r in M.duties(m, "k", "name", words).collect()} == {1: "load", 2: "utility"}
    cols = "scope string, method string, calls array<string>, attributes array<string>, keywords array<string>, scores map<string,double>"
    g = frame(spark, [("A", "f", ["g"], ["x"], [], {}), ("A", "g", [], ["y"], [], {}), ("A", "h", [], ["q"], ["k"], {"io": 0.2}), ("A", "i", None, None, None, None), ("B", "p", [], ["x"], ["k"], {"io": 0.2}), ("B", "q", [], ["x"], [], {"io": 0.1})], cols)
    got = {r.method: r.group for r in M.greedy_groups(g, "scope").collect()}
    # f calls g: .4; p and q: .2 for attributes, .1 for scores
    assert got == {"f": "cohesion_group_1", "g": "cohesion_group_1", "h": "utility_support", "i": "utility_support", "p": "cohesion_group_1", "q": "cohesion_group_1"}
    acc = frame(spark, [("A", "f", "x"), ("A", "f", "y"), ("A", "g", "x"), ("A", "g", "y"), ("A", "h", "x")], "scope string, m string, a string")
    assert rows(M.shared_feature_groups(acc, "scope", "m", "a")) == [("f", "f"), ("g", "f")]
    att = M.attached_private(frame(spark, [("pub", 1), ("_a", None), ("_b", None)], "method string, group int"), frame(spark, [("pub", "_a"), ("_a", "_b")], "caller string, callee string"))
    assert {r.method: r.group for r in att.collect()} == {"pub": 1, "_a": 1, "_b": 1}


def test_sinks(spark, tmp_path):
    old, new = frame(spark, [(1, "a"), (2, "b")], "k int, v string"), frame(spark, [(2, "c"), (3, "d")], "k int, v string")
    assert rows(sinks.merged(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(sinks.without_orphans(old, new, "k")) == [(2, "b")] and sinks.emptied(old).count() == 0
    nested = frame(spark, [(1, ["x", "y"], {"p": 1})], "k int, a array<string>, m map<string,int>")
    sinks.write_csv(nested, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().a == "x; y"
    sinks.write_json(nested, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 1
    assert sinks.markdown(frame(spark, [("a|b",)], "x string")).endswith("| a\\|b |")
    assert "n0 --> n1" in sinks.mermaid(frame(spark, [("a", "b")], "s string, t string"), "s", "t")


def test_transaction(spark, tmp_path):
    target = str(tmp_path / "t")
    assert sinks.committed(spark, target) is None
    for k in range(2):
        with sinks.transaction(spark, target) as path:
            spark.range(k + 1).write.parquet(f"{path}/a")
        assert spark.read.parquet(sinks.committed(spark, target) + "/a").count() == k + 1
    before = sinks.committed(spark, target)
    with pytest.raises(ValueError), sinks.transaction(spark, target) as path:
        spark.range(5).write.parquet(f"{path}/a")
        raise ValueError("no")
    assert sinks.committed(spark, target) == before


def test_map_filter_reduce(spark):
    from quarrylens.plans import extensions as E

    df = spark.range(100).repartition(3)
    assert E.parallel_map(df, lambda b: b.assign(id=b["id"] * 2), "id long").agg(F.sum("id")).first()[0] == 9900
    assert E.parallel_filter(df, lambda b: b["id"] < 10).count() == 10
    assert E.parallel_reduce(df, lambda b: b[["id"]].sum().to_frame().T, "id long").collect()[0][0] == 4950
    with E.cached(df) as (held,):
        assert held.is_cached and held.count() == 100
    assert not df.is_cached and len(E.POINTS) == 16


def test_named_within(spark):
    names, texts = frame(spark, [("run",), ("x.y",), ("zed",), ("",), (None,)], "n string"), frame(spark, [("def test_running(): pass",), ("a x.y b",)], "t string")
    assert rows(J.named_within(names, "n", texts, "t")) == [("run",), ("x.y",)]
    assert J.named_within(names.limit(0), "n", texts, "t").count() == 0


def test_registry_and_steps(spark):
    r, df = Registry(), frame(spark, [(1,)], "k int")
    r.hook("after_findings", "add", lambda d: d.withColumn("x", F.lit(1)))
    r.hook("after_findings", "bad", lambda d: d.select("nope"), priority=1)
    assert r.apply("after_findings", df).columns == ["k", "x"] and "bad" in r.failed
    with pytest.raises(Exception):
        r.apply("after_findings", df, stop_on_error=True)
    with pytest.raises(ValueError):
        r.plugin("other", "x", lambda d: d)
    r.rule("custom", lambda **f: frame(spark, [(9,)], "k int"))
    assert rows(r.decisions(df)) == [(1,), (9,)]
    done, failed = steps_of([(1, "a", lambda: df), (5, "b", lambda: 1 / 0), (0, "c", lambda: df)], least=1)
    assert list(done) == ["a"] and "ZeroDivisionError" in failed["b"]


def test_schema_drift(spark):
    df = frame(spark, [("f", "x", 1)], "file_path string, message string, extra int")
    assert schemas.drift(df, "errors") == {"missing": [], "extra": ["extra"], "type": []}


def test_join_unique_splits_hot_keys(spark):
    from quarrylens.operators import skew

    left = spark.createDataFrame([(k % 3 if k < 90 else k, k % 2, k) for k in range(100)] + [(None, 0, 200)] * 30, "k long, j long, v long")
    right = spark.createDataFrame([(k, j, f"{k}-{j}") for k in range(95) for j in range(2)], "k long, j long, w string")
    assert sorted(n for *_, n in skew.hot_keys(left, ["k"], hot_rows=20)) == [30, 30, 30, 30]
    for how in ("inner", "left"):
        want = left.join(right, ["k", "j"], how).collect()
        for counts in (None, left.groupBy("k", "j").count().withColumnRenamed("count", "n")):
            got = skew.join_unique(left, right, ["k", "j"], how, counts, hot_rows=10)
            key = lambda r: tuple(map(repr, r))
            assert got.columns == ["k", "j", "v", "w"] and sorted(map(key, got.collect())) == sorted(map(key, want))
    assert skew.hot_keys(left, ["k"]) == []


def test_kept_tables_are_released(spark, tmp_path):
    import threading

    from quarrylens import storage

    e = frame(spark, [("a", "b"), ("b", "c")], "a string, b string")
    got = G.components(e, "a", "b")
    assert got.count() == 3 and len(storage._kept) > 0 and not storage._scopes()
    seen = []
    with storage.scratch(spark):
        worker = threading.Thread(target=lambda: seen.append(len(storage._scopes())))
        worker.start()
        worker.join()
        inner = storage.written(e, "inner")
        assert inner.count() == 2
    assert seen == [0]
    with pytest.raises(Exception, match="."):
        inner.count()
    storage.release(spark)
    assert not [p for app, p in storage._kept if app == spark.sparkContext.applicationId]


def test_concrete_duplicates(spark):
    body = ["a = 1", "b = 2", "  c = 3", "d = 4"]
    text = "\n".join([*body, "# note", "x", *body, "y", "z", "", "q"])
    got = C.repeated_windows(frame(spark, [("f", text), ("g", "a\nb")], "k string, t string"), "k", "t")
    best = got.orderBy(F.desc("savings"), F.desc("size")).first()
    assert (best.k, best.size, best.starts, best.savings) == ("f", 4, [1, 7], 4) and got.where("size = 3").count() >= 2
    assert [(r.size, r.starts) for r in C.greedy_fragments(got, "k").collect()] == [(4, [1, 7])]
    kinds = frame(spark, [("FunctionDef(2,Assign,If(Return,Expr(Call(1))),Return)",), ("FunctionDef(0,Pass)",), ("ClassDef(Pass)",)], "s string").select(C.statement_kinds(F.col("s")).alias("k")).collect()
    assert [r.k for r in kinds] == [["Assign", "If", "Return"], ["Pass"], []]
    f = [("m", "u1", "FunctionDef(1,Assign,Return)", "function"), ("m", "u2", "FunctionDef(9,Return,Assign,Assign)", "method"), ("m", "u3", "FunctionDef(1,Assign,For,If,Return,Expr(Call(0)))", "function"), ("m", "u4", "FunctionDef(1,Assign,For,If,Return,Expr(Name),While(Pass))", "function"), ("n", "u5", "FunctionDef(1,Assign,Return)", "function")]
    assert rows(C.similar_bodies(frame(spark, f, "file_path string, symbol_uid string, structure string, kind string")).select("a", "b", F.round("similarity", 3))) == [("u1", "u2", 1.0), ("u3", "u4", 0.833)]
