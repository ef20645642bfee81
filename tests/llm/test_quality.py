import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import quality, rules, textstats, toxicity
from codeloom.llm.queries import op5_rules, op7_toxicity, op8_quality

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", " ", "\n", "\t", "\x0b", "é", "\xa0", "#", "a b a b", "|"]), max_size=40).map("".join))
def test_base_counts(text):
    assert textstats.statistics(text)[:5] == brute(text)


def test_rules_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = op5_rules(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        n, *rest = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n) and not (r.base_failed and r.kept)
    judged = [(r.kept, good[r.doc_id]) for r in out if r.doc_id in good and not r.base_failed]
    assert np.mean([k == bool(g) for k, g in judged]) > 0.9


def test_rules_edges(spark, docs):
    stats = textstats.text_statistics(docs([(1, None), (2, ""), (2, ""), (None, "word " * 100_000)]))
    assert sorted(map(str, stats.select("doc_id", "n_words").collect())) == sorted(
        ["Row(doc_id=1, n_words=0)", "Row(doc_id=2, n_words=0)", "Row(doc_id=2, n_words=0)", "Row(doc_id=None, n_words=100000)"]
    )
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert rules.fit(textstats.labelled(stats, labels, "quality")) == []
    assert stats.where(rules.verdict([])).count() == 4
    assert textstats.text_statistics(docs([])).count() == 0


def test_learned_rules_are_found():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    y = 1 - ((x["a"] > 0.7) & (x["b"] <= 0.4)).astype(int)
    learned = rules.learn(x, y)
    hit = np.logical_or.reduce([rules.covers(r, x) for r in learned])
    assert ((1 - hit) == y).mean() > 0.98


def test_classifier_held_out(spark):
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [r for r in op8_quality(spark, SF).collect() if r.held_out and r.doc_id in good]
    assert np.mean([(r.predicted == 1) == (good[r.doc_id] == 1) for r in out]) > 0.9
    assert all(0 <= r.score <= 1 for r in out)


def test_normal_equations_and_isotonic(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(v[0] > 0), *map(float, v)) for i, v in enumerate(rng.normal(size=(600, len(textstats.SHARES))))]
    kinds = "doc_id long, y int, " + ", ".join(f"{c} double" for c in textstats.SHARES)
    table = spark.createDataFrame(rows, kinds).repartition(7)
    model = quality.fit(table)
    f = model.features(np.array([r[2:] for r in rows]))
    y = np.array([r[1] for r in rows], float)
    direct = np.linalg.solve(f.T @ f + quality.PENALTY * len(y) * np.eye(f.shape[1]), f.T @ y)
    assert np.allclose(f @ direct, f @ model.weights, atol=1e-6)
    assert quality.fit(table.where("y > 5")) is None
    assert {r.score for r in quality.score(table, None, ["doc_id"]).collect()} == {0.5}
    knots, values = quality.isotonic(np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1]))
    assert (np.diff(values) >= 0).all() and np.interp(3, knots, values) == np.float64(1 / 3) and values[-1] == 1


def test_gradients():
    rng = np.random.default_rng(2)
    words = ["aa", "bcd", "efgh", "scum", "é"]
    net = toxicity.Network({"aa": 1, "scum": 2}, np.array([0.1, 2.0]), rng.normal(size=toxicity.TRIGRAMS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    at = rng.integers(1, 6, (4, 7))
    at[1, 4:] = 0
    y, w = np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 1, 1])
    _, g = net.gradients(words, at, y, w)
    for name in ("words", "chars", "x", "bx", "u", "a", "ba", "v", "w", "b"):
        flat = g[name].ravel()
        for i in np.argsort(-np.abs(flat))[:3]:
            losses = []
            for d in (1e-3, -1e-3):
                net.p[name].ravel()[i] += d
                losses.append(net.gradients(words, at, y, w)[0])
                net.p[name].ravel()[i] -= d
            assert abs((losses[0] - losses[1]) / 2e-3 - flat[i]) < 2e-3 + 0.02 * abs(flat[i]), name


def test_toxicity_held_out(spark, docs):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = {r.doc_id: r for r in op7_toxicity(spark, SF).collect()}
    held = [r for r in out.values() if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.85
    assert all(0 <= r.score <= 1 for r in out.values())


def test_toxicity_edges(spark, docs):
    rng = random.Random(1)
    vocabulary = "the quiet house stands near a river with many trees and birds under an old stone bridge".split()

    def clean(n):
        return " ".join(rng.choices(vocabulary, k=n))

    def bad(n):
        return f"{clean(n)} you worthless scum {clean(n)}"

    net = toxicity.train([clean(60) for _ in range(80)] + [bad(30) for _ in range(80)], np.array([0] * 80 + [1] * 80))
    long, last = clean(2000), bad(1000)
    table = docs([(1, None), (2, ""), (3, long), (4, last), (None, clean(9)), (4, last)])
    out = toxicity.predict(table, net).collect()
    assert [r.doc_id for r in out] == [1, 2, 3, 4, None, 4]
    assert [r.score >= 0.5 for r in out[2:]] == [False, True, False, True] and out[3].score == out[5].score
    assert toxicity.train(["a"], np.array([1])) is None
    assert {r.score for r in toxicity.predict(table, None).collect()} == {0.0}
    assert toxicity.windows(0) == [(0, 0)] and toxicity.windows(33) == [(0, 32), (16, 33)]
