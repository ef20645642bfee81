import numpy as np
import pytest

import corpus_pipeline
from codeloom.llm import bpe, langid
from tests.llm.test_duplicates import brute_removed
from tests.llm.test_minhash import brute_kept
from tests.llm.test_scans import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and result, written and read again."""
    sf, out = "/root/testdata/sf0.001", []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        f(spark, docs, sf).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((docs, new))
        docs = new
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language(spark, stages):
    before, after = stages[0]
    classify = langid.Classifier(langid.fit(before))
    assert rows(after) == [(d, t) for d, t in rows(before) if classify(t)[2]]
    assert after.count() > 0.97 * before.count()


def test_one_of_each_group(stages):
    """Groups of texts whose sets of five-word shingles are similar by 0.8 or more."""
    given = rows(stages[1][0])
    kept = set(brute_kept([(d, t or "") for d, t in given]))
    assert rows(stages[1][1]) == [r for r in given if r[0] in kept]


def test_repeats(stages):
    given = rows(stages[2][0])
    kept = {d: (gone, words) for d, _, gone, words in brute_removed(given)}
    assert rows(stages[2][1]) == [(d, kept[str(d)][1] if kept[str(d)][0] else t) for d, t in given]
    assert stages[2][1].where("n_chars != length(text)").count() == 0


def test_secrets(stages):
    for (_, t), (_, new) in zip(*map(rows, stages[3])):
        assert (t == new) == (not brute(t)) and not brute(new)


def test_packing(spark, stages):
    texts, out = dict(rows(stages[4][0])), {}
    for r in stages[4][1].collect():
        out.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    e = bpe.encoder(bpe.word_tokenizer())
    for d, t in texts.items():
        assert sum((ids for _, ids in sorted(out[d])), []) == e.tokenizer.encode(t, add_special_tokens=False).ids + [2]


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in out.collect()) == sorted(
        (r.doc_id, r.start, r.ids_crc32) for r in stages[4][1].collect()
    )


def test_empty_and_null(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for data in ([], [(None, None, None, None, None), (1, "", "en", "s", 0)]):
        docs = spark.createDataFrame(data, kinds)
        for i, (name, f) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(data)}-{name}")
            f(spark, docs, "").write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.count() == 0 or i == 0
