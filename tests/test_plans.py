"""What the plans must and must not contain."""

import pytest

from codeloom.operators import similarity
from codeloom.plans.queries import QUERIES

NARROW = [
    "comment_cleanup", "body_normalized", "code_line_counts", "function_names", "good_doc_flags",
    "doc_strip_signature", "doc_first_line", "complete_functions", "documented_basic", "token_counts",
    "extract_basic", "rejected_files",
]
PYTHON = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "Window Python")


@pytest.fixture
def plan(spark, sf, monkeypatch):
    """The physical plan before adaptive changes, without the spreading of small inputs."""
    monkeypatch.setattr("codeloom.plans.views.spread", lambda df, *key: df)

    def run(name):
        return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()

    return run


@pytest.mark.parametrize("name", NARROW)
def test_narrow_queries_do_not_shuffle(plan, name):
    assert "Exchange" not in plan(name)


#: These yield finished figures.
NOT_JVM = {"kmeans_quality_sweep", "silhouette_labels"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NOT_JVM))
def test_no_python_rows(plan, name):
    text = plan(name)
    assert not any(node in text for node in PYTHON)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["dedup_normalized_body", "dedup_doc_sig_body", "curated_functions"])
def test_dedup_drops_copies_before_its_one_shuffle(plan, name):
    text = plan(name)
    assert text.count("Exchange hashpartitioning") == 1
    partial = text.index("Partial")
    assert text.index("Exchange hashpartitioning") < partial, "the partial limit runs below the exchange"


def test_counters_shuffle_no_text(plan):
    text = plan("curate_counters")
    exchange = next(line for line in text.splitlines() if "Exchange hashpartitioning" in line)
    assert "hash" in exchange and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["decontaminate_names", "resume_anti", "first_n_authors", "ngram_pair_similarity"])
def test_small_sides_are_broadcast(plan, name):
    assert "BroadcastHashJoin" in plan(name)


def test_filters_and_columns_reach_the_scan(plan):
    text = plan("resume_anti")
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)" in text
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in text
    assert "text:string" not in plan("distinct_authors")


def test_ngrams_are_counted_without_a_shuffle(plan):
    text = plan("ngram_pair_similarity")
    top = text[: text.index("BroadcastExchange")]
    assert top.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in top


def test_corpus_ngrams_explode_once(spark, sf, plan, monkeypatch):
    monkeypatch.setattr(similarity, "materialize", lambda df, name: df)
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    counted = similarity.gram_counts(texts, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert counted.count("Generate explode") == 1 and counted.count("Exchange hashpartitioning") == 1
    monkeypatch.undo()
    assert "Generate" not in plan("ngram_corpus_similarity")


def test_texts_are_not_taken_apart_in_filters(plan):
    filters = [line for line in plan("extract_syntax").splitlines() if "Filter" in line]
    assert filters and not any("regexp" in line or "RLIKE" in line for line in filters)
