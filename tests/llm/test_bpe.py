import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import bpe, packing

PARTS = ["a", "B", "the ", "'s", "''", "é", "é", "Σ", "ß", "\x85", "\xa0", " ", "!?", "12", "漢字", "\U0001f600", "가", "가"]
PARTS += ["<|endoftext|>", "<|endo", " \t\n", "İ", "\x1c", "zz", "thanthe"]
texts = st.lists(st.sampled_from(PARTS), max_size=60).map("".join)


@pytest.fixture(scope="module")
def spec():
    return bpe.word_tokenizer()


def library(spec, text):
    return bpe.encoder(spec).tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_as_the_library(text):
    spec = bpe.word_tokenizer()
    assert np.frombuffer(bpe.encoder(spec).ids(text), "<u4").tolist() == library(spec, text)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 40))
def test_tree_of_leaves_is_exact(text, leaf):
    spec = bpe.word_tokenizer()
    e = bpe.encoder(spec)
    leaves = [e.tokens(text[i : i + leaf]) for i in range(0, max(1, len(text)), leaf)]
    assert e.tree(leaves).ids.tolist() == library(spec, text)


@pytest.mark.parametrize("unit", ["ab", "thing", "é", "1", "!?", "a b"])
def test_tree_of_one_long_word(spec, unit):
    text = unit * 3000
    e = bpe.encoder(spec)
    assert e.tree([e.tokens(text[i : i + 777]) for i in range(0, len(text), 777)]).ids.tolist() == library(spec, text)


def test_encode_and_decode(spark, docs, spec):
    long = "Some words, and SOME more; " * 900 + "x" * 3000
    rows = [(1, "Hello, World"), (2, None), (3, ""), (4, long), (4, long), (None, "a" * 5000), (5, "  \n ")]
    out = bpe.decode(bpe.encode(docs(rows), spec, leaf=1000), spec).collect()
    assert len(out) == len(rows)
    wanted = sorted((str(d), library(spec, t)) for d, t in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in out) == wanted
    for r in out:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.n_tokens == len(ids)
        assert r.decoded == bpe.encoder(spec).tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs([]), spec).count() == 0


def test_pieces():
    for n in [1, 2, 3, 4095, 4096, 4097, 10_000]:
        cut = packing.pieces(n)
        assert sum(cut) == n and all(x & (x - 1) == 0 and x <= 4096 for x in cut)
        assert len(set(x for x in cut if x < 4096)) == len([x for x in cut if x < 4096])


def test_pack(docs, spec, tmp_path):
    rows = [(1, "Hello, World " * 2000), (2, None), (3, ""), (1, "Hello, World " * 2000), (None, "abc")]
    packed = packing.pack(docs(rows), spec)
    out = packed.collect()
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 for r in out)
    for d, t in rows:
        own = sorted((r for r in out if r.doc_id == d), key=lambda r: (r.start, r.sequence_id))
        ids = library(spec, t) + [2]
        copies = sum(x == (d, t) for x in rows)
        for r in own:
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length]
            assert r.doc_tokens == len(ids) and r.sequence_id >> 59 == r.length.bit_length() - 1
        assert sum(r.length for r in own) == copies * len(ids)
    packing.write_buckets(packed, str(tmp_path / "out"))
    again = packed.sparkSession.read.parquet(str(tmp_path / "out"))
    assert again.where("bucket != length").count() == 0 and again.count() == len(out)
    assert packing.pack(docs([]), spec).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs([]), spec, longest=1000)


def test_query_digests(spark, sf, spec):
    from codeloom.llm.queries import op1_bpe, op4_packing

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_bpe(spark, sf).collect():
        ids = np.array(library(spec, texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        text = bpe.encoder(spec).tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    for r in op4_packing(spark, sf).collect():
        ids = np.array(library(spec, texts[r.doc_id]) + [2], "<u4")[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())
