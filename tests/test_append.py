"""Batches added to a corpus keep one row per body over all runs."""

from codeloom.operators.dedup import by_normalized_body
from codeloom.plans.append import append_new, corpus_rows
from codeloom.schemas import KEY


def functions(spark, *rows):
    schema = "author string, project string, file_path string, line_number int, body string"
    return spark.createDataFrame([("a", "p", f"f{line}", line, body) for line, body in rows], schema)


def test_runs_equal_one_run(spark, tmp_path):
    corpus = str(tmp_path / "corpus")
    first = functions(spark, (1, "x = 1"), (2, "x = 1"), (3, None), (4, ""))
    second = functions(spark, (5, "x = 1"), (6, "y = 2"), (7, ""), (8, "y = 2"))
    append_new(first, corpus, 0)
    append_new(second, corpus, 1)
    got = sorted(r["line_number"] for r in corpus_rows(spark, corpus).collect())
    assert got == [1, 3, 6]
    whole = first.union(second).fillna("", ["body"])
    assert got == sorted(r["line_number"] for r in by_normalized_body(whole).select(*KEY).collect())


def test_a_repeated_batch_takes_its_own_place(spark, tmp_path):
    corpus = str(tmp_path / "corpus")
    append_new(functions(spark, (1, "x = 1")), corpus, 0)
    append_new(functions(spark, (2, "y = 2")), corpus, 1)
    append_new(functions(spark, (2, "y = 2"), (3, "z = 3")), corpus, 1)
    assert sorted(r["line_number"] for r in corpus_rows(spark, corpus).collect()) == [1, 2, 3]


def test_empty_batches(spark, tmp_path):
    corpus = str(tmp_path / "corpus")
    assert append_new(functions(spark), corpus, 0).count() == 0
    assert append_new(functions(spark, (1, "x = 1")), corpus, 1).count() == 1
