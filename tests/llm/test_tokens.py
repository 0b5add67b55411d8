"""BPE, packing and token files against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrylens.llm import bpe, common, packing, pretok, tokenfile, tokens

from .conftest import frame

LIBRARY = Tokenizer.from_file(tokens.vocabulary_path())


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def encoded(coder, texts, limit=1 << 16):
    raw, at = common.raw_text(pa.array(texts, pa.string()))
    out = []
    for lo, hi, part, off in common.slices(raw, at, limit):
        ids, cut = coder.encode(part, off)
        out += [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab 'stmdrvel\n\t.1<|endoftext|>é中😀\x1c\u3000"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=8))
def test_ids_equal_the_library(texts):
    want = [library_ids(t) for t in texts]
    assert encoded(bpe.bpe(tokens.vocabulary_path()), texts) == want
    assert encoded(tokens.library_coder(), texts) == want


def test_long_words_and_special_token():
    rng = random.Random(3)
    texts = ["a" * 5000, "ab" * 3000, "".join(rng.choice("abcdef") for _ in range(20000)), "<|endoftext|>" * 3, " <|endoftext|>", "<|endoftext", None, ""]
    assert encoded(bpe.bpe(tokens.vocabulary_path()), texts) == [library_ids(t) for t in texts]


def test_table_of_words_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "KEEP_WORDS", 5)
    coder = bpe.Bpe(tokens.vocabulary_path())
    texts = [f"word{k} other{k % 3} <|endoftext|>" for k in range(50)]
    assert encoded(coder, texts, 64) == [library_ids(t) for t in texts]


def test_white_space_classes():
    cls = pretok.classes()
    assert cls[0x20] == cls[0x3000] == pretok.SPACE and cls[0x1C] == pretok.OTHER and cls[ord("a")] == pretok.LETTER and cls[ord("½")] == pretok.NUMBER


def test_round_trip(spark, docs, texts):
    got = {r.doc_id: r for r in bpe.round_trip(docs, keep_ids=True).collect()}
    assert sorted(got) == list(range(len(texts)))
    for k, t in enumerate(texts):
        ids = library_ids(t)
        assert got[k].ids == ids and got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded == LIBRARY.decode(ids, skip_special_tokens=False)
        assert got[k].decoded_sha256 == hashlib.sha256(got[k].decoded.encode()).hexdigest()


def test_tournament_is_first_fit():
    rng = random.Random(5)
    sizes = np.array([rng.randrange(1, 1024) for _ in range(500)])
    bins, offsets = packing.first_fit_decreasing(sizes, 1024)
    room, want = [], {}
    for k in np.argsort(-sizes, kind="stable").tolist():
        b = next((i for i, r in enumerate(room) if r >= sizes[k]), None)
        if b is None:
            room.append(1024)
            b = len(room) - 1
        want[k] = (b, 1024 - room[b])
        room[b] -= sizes[k]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [want[k] for k in range(len(sizes))]


@pytest.mark.parametrize("group", [4, 16384])
def test_packing(spark, texts, group):
    docs = frame(spark, [*texts, texts[0]], [*range(len(texts)), 0])  # one row repeats
    rows = packing.pack(docs, group=group).collect()
    want = defaultdict(list)
    for i, t in zip([*range(len(texts)), 0], [*texts, texts[0]]):
        want[i].append([*library_ids(t), 0])
    seen, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][0]
        assert r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert seen == {i: sum(map(len, x)) for i, x in want.items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_bits(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1000).astype(np.uint32)
    assert (tokenfile.unpack_bits(tokenfile.pack_bits(ids, bits), 1000, bits) == ids).all()
    assert len(tokenfile.pack_bits(ids, bits)) == 16 * 8 * bits


def test_token_files(spark, texts, tmp_path, monkeypatch):
    ids = [3 * k - 7 for k in range(len(texts))]
    docs = frame(spark, [*texts, "null id", texts[0]], [*ids, None, ids[0]])
    files = tokenfile.write(docs, f"file://{tmp_path}/tokens")
    got = sorted(tokenfile.read(files).collect(), key=lambda r: r.start)
    order = [None, ids[0], *ids]
    assert [r.doc_id for r in got] == order
    start = 0
    for r, t in zip(got, ["null id", texts[0], *texts]):
        want = np.array([*library_ids(t), 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    one = files.orderBy("part", "file").first()
    f = tokenfile.Reader(one.path)
    every = np.concatenate([f.document(k) for k in range(f.docs)])
    assert len(every) == one.ids and (f.range(5, 9) == every[5:9]).all() and (f.range(3, 3).size == 0)
    f.close()


def test_blocks_smaller_than_documents(monkeypatch, tmp_path):
    monkeypatch.setattr(tokenfile, "BLOCK", 64)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50257, n).astype(np.uint32) for n in (1, 63, 64, 65, 1000, 1)]
    w = tokenfile.Writer(f"{tmp_path}/x.ids", 16)
    for k, d in enumerate(docs):
        w.add(pa.array([k]), np.array([len(d)]), d)
    w.close()
    r = tokenfile.Reader(f"{tmp_path}/x.ids")
    assert all((r.document(k) == d).all() for k, d in enumerate(docs))
    assert r.checksums().tolist() == [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]


def test_empty_tables(spark, empty):
    assert bpe.round_trip(empty).count() == packing.pack(empty).count() == tokenfile.written_and_read(spark, empty).count() == 0
