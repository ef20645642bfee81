"""Token counts of prefixes against the library."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from codeloom.llm import prefixcounts, queries


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_proto=prefixcounts.piece_model())


def texts():
    rng = random.Random(1)
    letters = [*"abcdefghi  \n\t é½ﬁ日本語😀\u0301<s>/▁0123.,'\"\\_{}()\0", "the ", "ing", "<s>", "    ", "aaaa", "</s>", "<0x0A>"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]


def test_every_prefix(library):
    c = prefixcounts.Counter(prefixcounts.piece_model())
    for t in texts():
        wanted = [len(library.encode(t[:i])) for i in range(1, len(t) + 1)]
        assert np.cumsum(c.steps(t), dtype=int).tolist() == wanted, repr(t)


@pytest.mark.parametrize("text", ["", " ", "a" * 30_000, " " * 5_001, "日本" * 4_000, "0123456789abcdef" * 2_000, "x\n" * 3_000])
def test_long_runs(library, text):
    c = prefixcounts.Counter(prefixcounts.piece_model())
    assert int(c.steps(text).sum(dtype=int)) == len(library.encode(text))


def test_query(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate([*texts()[:300], None, "", "word " * 4097, "word " * 4095])] + [(None, "x"), (3, "y"), (3, "y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_prefixcounts(spark, str(tmp_path)).collect()
    wanted = [(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t in rows]
    assert sorted(map(repr, map(tuple, out))) == sorted(repr((*w, w[2] > 4096)) for w in wanted)


def test_whole_table(spark, sf, library):
    out = queries.op13_prefixcounts(spark, sf).collect()
    given = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in out} == {d: len(library.encode(t)) for d, t in given.items()}
    assert len(out) == len(given)


def test_budgets_and_places(spark, docs, library):
    rows = list(enumerate(t for t in texts()[:200]))
    counts = prefixcounts.prefix_counts(docs([*rows, (500, None)]), prefixcounts.piece_model())
    cut = prefixcounts.truncated(counts, F.when(F.col("doc_id") == 7, None).otherwise(F.col("doc_id") % 9)).collect()
    at = prefixcounts.counts_at(counts, F.array(F.lit(-1), F.lit(3), F.lit(None), F.lit(10**6))).collect()
    given = dict(rows)
    for r in cut:
        t, most = given.get(r.doc_id, ""), r.doc_id % 9
        sizes = [len(library.encode(t[:i])) for i in range(len(t) + 1)]
        fits = [i for i, n in enumerate(sizes) if r.doc_id == 7 or n <= most]
        assert (r.kept_chars, r.kept_tokens) == (fits[-1], sizes[fits[-1]])
    for r in at:
        t = given.get(r.doc_id, "")
        assert r.counts == [0, len(library.encode(t[:3])), None, len(library.encode(t))]


def test_no_rows_and_other_models(spark, docs):
    assert prefixcounts.prefix_counts(docs([]), prefixcounts.piece_model()).count() == 0
    with pytest.raises(Exception):
        prefixcounts.require_supported(b"no model")
