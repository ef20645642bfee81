"""The most frequent n-grams, length by length, against counts of all of them."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.functions.bytetokens import TokenHashes
from codeloom.functions.tokens import token_pattern
from codeloom.operators import similarity


def most_frequent(texts, m, max_n):
    grams = Counter()
    for t in (x.split() for x in texts if x):
        grams.update((n, " ".join(t[i : i + n])) for n in range(1, max_n + 1) for i in range(len(t) - n + 1))
    return [(n, g, c) for (n, g), c in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:m]]


@pytest.mark.parametrize("m, words", [(0, 9), (3, 9), (12, 9), (40, 3), (400, 30)])
def test_most_frequent_of_all_lengths(spark, m, words):
    rng = random.Random(m)
    texts = [None, "", "é", "b"] + [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCD"[:words]) for _ in range(k)) for k in range(40)]
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert [tuple(r) for r in similarity.trivial_ngrams(table, "text", m).collect()] == most_frequent(texts, m, 4)


def test_only_grams_of_frequent_parts_are_counted(spark):
    table = spark.createDataFrame([("a b a b c a",)] * 3 + [("b x c y z",)], "text string").coalesce(1)
    assert sorted(map(tuple, similarity._counted(table, [["a", "b"]]).collect())) == [("a b", 6), ("b a", 3)]


def test_corpus_similarity_writes_and_shuffles_no_row_per_ngram(spark, monkeypatch):
    """A few bundles of bytes instead; many buckets and bundles give what all pairs of texts give."""
    monkeypatch.setattr(similarity, "BUCKET", 50)
    rng = random.Random(1)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randrange(30))] for _ in range(40)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    counts = [Counter(tuple(t[i : i + n]) for n in range(1, 5) for i in range(len(t) - n + 1)) for t in texts]
    drop = {tuple(g.split()) for _, g, _ in most_frequent([" ".join(t) for t in texts], 10, 4)}
    expected = {}
    for i, own in enumerate(counts):
        best = {g: max(c[g] for j, c in enumerate(counts) if j != i) for g in own if g not in drop}
        expected[i] = sum(min(own[g], n) for g, n in best.items()), sum(own[g] for g in best)
    monkeypatch.delattr(similarity, "materialize")
    got = similarity.corpus_similarity(table, "id", "text", 10)
    assert {r["id"]: (r["matched"], r["total"]) for r in got.collect()} == expected


def test_pieces_of_texts_are_smaller_than_their_ngrams(spark):
    """A token goes with some three tokens in two bytes, not as four hashes with their text; no n-gram is lost or doubled."""
    rng = random.Random(2)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(rng.choice([0, 1, 2, 3, 700]))) for _ in range(60)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "name long, text string").coalesce(1)
    tokens = sum(len(t.split()) for t in texts)
    keys = spark.sparkContext.broadcast(similarity._Keys([t for t, _ in similarity._frequent(table, "text", 10)]))
    pieces = similarity._bundles(table, keys, np.empty(0, np.uint64), 3, 8, 4).cache()
    assert pieces.selectExpr("sum(octet_length(cells)) AS n").first()["n"] < 8 * tokens
    sums = similarity._scores(pieces.repartition(2, "bucket").sortWithinPartitions("bucket"), {}, 3, 4)
    got = similarity._named(sums.repartition(2, "bundle").sortWithinPartitions("bundle", F.desc("bucket")))
    assert {r["name"]: r["total"] for r in got.collect()} == {
        i: sum(max(0, len(t.split()) - n) for n in range(4)) for i, t in enumerate(texts)
    }


def test_most_frequent_tokens_by_partition(spark, monkeypatch):
    """The first are exact; each partition sends no more than its share of the codes."""
    monkeypatch.setattr(similarity, "CODES", 40)
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(200)) for _ in range(20)]
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    found = similarity._frequent(table, "text", 9)
    assert [(1, *r) for r in found[:9]] == most_frequent(texts, 9, 1)
    assert len(found) <= 9 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_hashes_of_tokens_follow_the_pattern():
    texts = [None, "", "é aé_b  <|endoftext|>x <|unk|", "a", "b c \U0001f600\U0001f600x", "ab", "cd ef", "\r\n\x0bq\x1c ab", "日本 ab"]
    split, names = re.compile(token_pattern()).findall, {}
    for column in (pa.array(texts), pa.array(texts)[3:], pa.array([t for t in texts if t and "<" not in t] * 3)):
        for at, hashes, ends in TokenHashes()(column):
            for text, own in zip(column[at : at + len(ends)].to_pylist(), np.split(hashes, ends[:-1])):
                found = split(text or "")
                assert len(found) == len(own) and all(names.setdefault(t, h) == h for t, h in zip(found, own.tolist()))
    assert len(set(names.values())) == len(names)
    assert TokenHashes().of_tokens(list(names)).tolist() == list(names.values())
