"""Near duplicates, line dedup, fingerprints and the pipeline by brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from quarrylens.llm import fingerprint, jaccard, linededup
from quarrylens.llm.components import components

from .conftest import frame, words

WORD = r"[^\x20\x09-\x0D]+"
ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(WORD, (text or "").translate(ASCII))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts, ids):
    sets = [shingles(t) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    least = {}
    for k in range(len(texts)):
        r = find(k)
        least[r] = min(least.get(r, ids[k]), ids[k])
    return [(ids[k], len(sets[k]), least[find(k)]) for k in range(len(texts))]


def chains(rng):
    """Texts of which neighbours link and the ends do not, in shuffled order,
    beside groups of near copies that share rare words."""
    out = []
    w = [f"c{k}" for k in range(100)]
    for k in range(12):
        out.append(" ".join(w))
        w[8 * k : 8 * k + 1] = [f"z{k}"]
        w[50 + 4 * k] = f"y{k}"
    core = [f"g{k}" for k in range(80)]
    for k in range(40):
        v = list(core)
        for _ in range(rng.randrange(3)):
            v[rng.randrange(80)] = f"e{rng.randrange(1000)}"
        out.append(" ".join(v))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, texts, seed):
    rng = random.Random(seed)
    every = [*texts, *chains(rng)] if seed == 1 else chains(rng)
    ids = rng.sample(range(1000), len(every))
    got = jaccard.join(frame(spark, every, ids)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(every, ids))


def test_split_lists_equal_brute_force(spark):
    """Tokens of more than 200 sets, whose lists are split into parts of some twenty."""
    rng = random.Random(9)
    core = [f"g{k}" for k in range(100)]
    every = []
    for _ in range(260):
        w = list(core[: rng.choice([100, 100, 92, 85, 70])])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        every.append(" ".join(w))
    got = jaccard.join(frame(spark, every), list_part=20).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(every, list(range(len(every)))))
    classes = np.zeros(1 << jaccard.COUNT_BITS, np.uint64)
    orders = jaccard.Orders(classes, np.full(1 << 14, 255, np.uint8), mean=90.0, list_part=20)  # every token of the last level
    assert orders.parts(np.arange(5, dtype=np.uint64)).tolist() == [7] * 5  # 90 times the root of 2, in twenties


def test_borderline_and_order_of_prefixes(spark):
    base = [f"t{k}" for k in range(104)]  # 100 shingles
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base[: 4 + 80]), " ".join(base[: 4 + 79]), " ".join(base) + " " + " ".join(f"u{k}" for k in range(25)), " ".join(base) + " " + " ".join(f"u{k}" for k in range(26))]
    got = jaccard.join(frame(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(texts, list(range(6))))


def test_prefix_filters_lose_nothing():
    """Any two sets that link share a token in their prefixes under every order."""
    rng = np.random.default_rng(2)
    orders = jaccard.Orders(rng.integers(0, 3, 1 << jaccard.COUNT_BITS).astype(np.uint64), rng.integers(0, 256, 1 << 14).astype(np.uint8))
    for n in (1, 2, 5, 50, 333):
        a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        keep = jaccard.needed(len(a))
        b = rng.permutation(a)[:keep]
        for j in range(3):
            assert np.intersect1d(orders.prefix(a, j), orders.prefix(b, j)).size


def test_signatures_lose_no_link():
    rng = np.random.default_rng(3)
    passed = 0
    for _ in range(2000):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        gone, new = rng.integers(0, len(a) // 4 + 1), rng.integers(0, len(a) // 4 + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(1, 1 << 62, new).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        may = jaccard.may_link(jaccard.signature(a), len(a), jaccard.signature(b), len(b))
        assert may or 5 * both < 4 * (len(a) + len(b) - both)
        passed += may
    assert passed < 1900


def test_one_of_each_group_stays(spark, texts):
    docs = frame(spark, [*texts, texts[0], "solo row", "solo row"], [*range(len(texts)), 0, None, None])
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    want = {c for _, n, c in brute_components(texts, list(range(len(texts)))) if n} | {k for k, t in enumerate(texts) if not shingles(t)}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_jaccard_empty(spark, empty):
    assert jaccard.join(empty).count() == jaccard.keep_first(empty).count() == 0


def test_component_labels(spark):
    rng = random.Random(4)
    order = rng.sample(range(200), 60)
    edges = list(zip(order, order[1:])) + [(500, 501), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in order} == {min(order)} and got[501] == 500 and len(got) == len({*order, 500, 501, 7})


# line dedup


def brute_dedup(rows, least=linededup.MIN_WORDS):
    """Remaining texts by comparing every pair of runs: rows are (id, text),
    distinct, in the order of their ids."""
    docs = []
    for i, t in rows:
        lines = (t or "").split("\n")
        docs.append((i, lines, [(k, x, len(re.findall(WORD, x))) for k, x in enumerate(lines) if re.findall(WORD, x)]))
    runs = []
    for d, (_, _, solid) in enumerate(docs):
        for s in range(len(solid)):
            n = 0
            for e in range(s, len(solid)):
                n += solid[e][2]
                if n >= least:
                    runs.append((tuple(x for _, x, _ in solid[s : e + 1]), d, s, e))
    first = {}
    for body, d, s, e in sorted(runs, key=lambda r: r[1:]):
        first.setdefault(body, (d, s))
    gone = [set() for _ in docs]
    for body, d, s, e in runs:
        fd, fs = first[body]
        if (d, s) > (fd, fs):
            gone[d] |= set(range(max(s, fs + len(body)) if d == fd else s, e + 1))
    out = {}
    for d, (i, lines, solid) in enumerate(docs):
        kept = [True] * len(lines)
        marks = sorted(gone[d])
        for a, b in zip(marks, marks[1:]):
            if b == a + 1:
                for k in range(solid[a][0], solid[b][0] + 1):
                    kept[k] = False
        for a in marks:
            kept[solid[a][0]] = False
        out[i] = "\n".join(x for x, ok in zip(lines, kept) if ok)
    return out


def lined_texts(seed):
    rng = random.Random(seed)
    short = [words(rng, 6) for _ in range(6)]
    long = [words(rng, 60) for _ in range(3)]
    mid = [words(rng, 25) for _ in range(5)]
    texts = []
    for _ in range(30):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            lines.append(rng.choice([rng.choice(short), rng.choice(mid), rng.choice(long), words(rng, 30), "", "  "]))
        texts.append("\n".join(lines))
    texts += [texts[0], texts[1], "\n".join([mid[0]] * 7), "\n".join([mid[1], mid[2]] * 4), None, "", "\n\n", long[0] + "\n\n" + long[1] + "\n" + long[0], "\n".join(short), "\n".join(words(rng, 1) for _ in range(60))]
    block = "\n".join(f"s{k}" for k in range(55))
    return [*texts, block, "intro\n" + block + "\nend", "\n".join(block.split("\n")[:49])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_equals_brute_force(spark, seed):
    texts = lined_texts(seed)
    got = {r.doc_id: r for r in linededup.dedup(frame(spark, texts)).collect()}
    want = brute_dedup(list(enumerate(texts)))
    for k in range(len(texts)):
        assert (got[k].text or "") == want[k], k
        assert got[k]._ld_removed == got[k]._ld_lines - (len(want[k].split("\n")) if got[k]._ld_removed < got[k]._ld_lines else 0)


def test_planted_passage_goes_once(spark):
    rng = random.Random(9)
    passage = "\n".join(words(rng, 18, 10**6) for _ in range(3))
    texts = [f"{words(rng, 40, 10**6)}\n{passage}\n{words(rng, 40, 10**6)}" for _ in range(5)] + [words(rng, 80, 10**6)]
    got = {r.doc_id: r.text for r in linededup.stage(frame(spark, texts)).collect()}
    assert [passage in got[k] for k in range(5)] == [True] + [False] * 4 and got[5] == texts[5]


def test_stage_keeps_columns_and_drops_emptied(spark):
    text = words(random.Random(1), 70)
    docs = frame(spark, [text, text, None, "", "clean"], [1, 2, 3, 4, 5])
    out = linededup.stage(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: text, 3: None, 4: "", 5: "clean"}


def test_repeated_rows_are_one_document(spark):
    text = words(random.Random(1), 70)
    got = linededup.dedup(frame(spark, [text, text, text], [None, None, 3])).collect()
    assert sorted((r.doc_id is None, r.text) for r in got) == [(False, ""), (True, text), (True, text)]


def test_line_dedup_empty(spark, empty):
    assert linededup.dedup(empty).count() == 0


# fingerprints


def parts(text):
    return {x for x in re.split("[\n.!?]+", text or "") if x.strip(" ")}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_equal_brute_force(spark, texts):
    rng = random.Random(6)
    more = [". ".join(words(rng, 5, 10**6) for _ in range(n)) for n in (3, 40, 400, 1500)]
    every = [*texts, *more, more[1]]
    ids = rng.sample(range(-500, 500), len(every))
    got = {r.doc_id: r for r in fingerprint.compare(frame(spark, every, ids)).collect()}
    order = sorted(range(len(every)), key=lambda k: -ids[k])
    assert len(got) == len(every)
    for at, k in enumerate(order):
        nxt = order[(at + 1) % len(order)]
        t, u, r = every[k] or "", every[nxt] or "", got[ids[k]]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert r.n_chars == len(t) and r.next_doc_id == ids[nxt]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(likeness(parts(t), parts(edited))) and r.near_next == pytest.approx(likeness(parts(t), parts(u)))
        if t == edited:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    assert got[ids[len(texts) + 1]].fingerprint == got[ids[-1]].fingerprint
    distinct = {frozenset(parts(t)) for t in every}
    assert len({r.fingerprint for r in got.values()}) == len(distinct)


def test_fingerprint_rows_that_repeat_and_single(spark, empty):
    got = fingerprint.compare(frame(spark, ["a. b", "a. b", "c"], [1, 1, None])).collect()
    assert sorted((r.doc_id or 0, r.next_doc_id or 0) for r in got) == [(0, 1), (1, 0)]
    one = fingerprint.compare(frame(spark, ["a. b. c"], [9])).collect()
    assert one[0].next_doc_id == 9 and one[0].near_next == 1
    assert fingerprint.compare(empty).count() == 0


def test_fingerprints_of_permuted_paragraphs(spark):
    lines = [f"line {k}" for k in range(4)]
    texts = ["\n".join(lines), "\n".join(reversed(lines)), "\n".join(lines[2:] + lines[:2])]
    for some in (texts[:2], texts):
        got = fingerprint.compare(frame(spark, some)).collect()
        assert len(got) == len(some) and all(r.near_next == 1 for r in got) and len({r.fingerprint for r in got}) == 1
        for r in got:
            text, following = some[r.doc_id], some[r.next_doc_id]
            edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
            assert r.near_edited == pytest.approx(likeness(parts(text), parts(edited)))


def test_fingerprints_of_reordered_neighbours(spark):
    """Both pairs of a document may cancel wholly; the document stays."""
    for rows in ({1: "b b.a a.", 2: "a a.b b."}, {1: "d.c.b.a.", 2: "a.b.c.d."}, {0: "q.r.s.t.", 1: "d.c.b.a.", 2: "a.b.c.d."}):
        got = {r.doc_id: r for r in fingerprint.compare(frame(spark, list(rows.values()), list(rows))).collect()}
        assert set(got) == set(rows)
        for i, r in got.items():
            edited = rows[i][: len(rows[i]) - len(rows[i]) // 2] + rows[r.next_doc_id][: len(rows[i]) // 2]
            assert r.near_next == pytest.approx(likeness(parts(rows[i]), parts(rows[r.next_doc_id])))
            assert r.near_edited == pytest.approx(likeness(parts(rows[i]), parts(edited)))


# the pipeline


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, blanks, repeated rows, columns whose names clash, and empty tables."""
    import corpus_pipeline as p

    rng = random.Random(8)
    names = "doc_id long, text string, _ld_id string, _ld_removed long, _chosen_id long, node string, kept boolean, component_id long, n_chars int"
    text = ["\n".join(words(rng, 30, 3000) for _ in range(3)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(text)] + [(None, None), (20, None), (21, ""), (22, " \n"), (3, text[3]), (3, text[3]), (30, text[4]), (None, text[5]), (31, "\n".join(text[6:9]))]
    for folder, data in (("some", rows), ("none", [])):
        where = str(tmp_path / folder)
        spark.createDataFrame([(i, t, f"v{i}", 7, i, "x", False, 5, len(t or "")) for i, t in data], names).write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(k, k % 2, 0) for k in range(6)] if data else [], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        docs = spark.read.parquet(f"{where}/documents.parquet")
        for name, stage in p.STAGES[:-1]:
            got = stage(spark, docs, where)
            assert got.columns == docs.columns, name
            for r in got.collect():
                assert r._ld_removed == 7 and r._ld_id == f"v{r.doc_id}" and r._chosen_id == r.doc_id and r.component_id == 5
        assert p.STAGES[-1][1](spark, docs, where).count() >= len(data) and p.run(spark, where).count() >= 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """The models' verdicts are taken from the operators (tested by themselves);
    what later stages do with them is done again by brute force."""
    import corpus_pipeline as p
    from quarrylens.llm import quality_pu, quality_rules

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    labels = spark.read.parquet(f"{src}/labels.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "ngram_jaccard", "packing"]
    rules = {r.doc_id for r in quality_rules.score(docs, quality_rules.train(docs, labels)).where("kept").collect()}
    left = docs.where(docs.doc_id.isin(*rules))
    chosen = {r.doc_id for r in quality_pu.score(left, quality_pu.train(left, labels)).where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in chosen)
    texts = {i: t for i, t in brute_dedup(rows).items() if t == dict(rows)[i] or re.search(WORD, t)}
    ids = sorted(texts)
    kept = {c for _, _, c in brute_components([texts[i] for i in ids], ids)}
    got = p.run(spark, src).collect()
    assert {r.doc_id for r in got} == kept
    from tokenizers import Tokenizer

    from quarrylens.llm import tokens

    library = Tokenizer.from_file(tokens.vocabulary_path())
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len(library.encode(texts[i], add_special_tokens=False).ids) + 1 for i in kept}
    for (_, stage), columns in zip(p.STAGES[:-1], [docs.columns] * 4):
        assert stage(spark, docs.limit(50), src).columns == columns
