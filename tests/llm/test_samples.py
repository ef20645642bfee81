"""Training samples lose no language and no label."""

import random

from codeloom.llm import langid, toxicity


def prose(rng, letters, n):
    words = random.Random(letters)
    known = ["".join(words.choice(letters) for _ in range(words.randrange(3, 9))) for _ in range(80)]
    return " ".join(rng.choice(known) for _ in range(n))


def test_languages_of_short_or_long_texts_only(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, "etaoin", 100), "usual") for i in range(60)]
    rows += [(100 + i, prose(rng, "qwzxyj", 12), "short") for i in range(60)]
    rows += [(200 + i, prose(rng, "bcdfgh", 3000), "long") for i in range(20)]
    rows += [(300, None, "none"), (301, "123 !", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.fit(docs)
    assert set(learned) == {"usual", "short", "long"} and all(len(d) <= langid.DICTIONARY for d in learned.values())
    classify = langid.Classifier(learned)
    assert classify(prose(rng, "qwzxyj", 80))[0] == "short" and classify(prose(rng, "bcdfgh", 80))[0] == "long"


def test_numerals_are_no_letters(spark):
    classify = langid.Classifier({"en": b"some text", "de": b"anderer text"})
    for text in ("\u00bd \u00b2", "\u2460", "\u2167", "12 _ !", "", None):
        assert classify(text) == (langid.UNKNOWN, 0.0, False)


def sampled(monkeypatch, docs, labels):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append((texts, y.tolist())))
    toxicity.fit(docs, labels)
    return seen[0]


def test_labels_on_long_texts_only(spark, monkeypatch):
    rows = [(i, "short" if i < 50 else "x" * 30_000) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 50)) for i in range(100)], "doc_id long, toxic int")
    texts, y = sampled(monkeypatch, docs, labels)
    assert 0 < sum(y) < len(y) and {len(t) for t in texts} == {5, toxicity.LONGEST}


def test_an_id_counts_once(spark, monkeypatch):
    rows = [(1, f"text {i}") for i in range(3000)] + [(2, "other"), (4, None), (3, "third")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 0), (3, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    texts, y = sampled(monkeypatch, docs, labels)
    assert len(texts) == len(y) <= 3
