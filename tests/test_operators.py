import math
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from codeloom.functions.stats import mcnemar_p_value
from codeloom.functions.stats import pass_at_k as pass_rate
from codeloom.operators import evaluate
from codeloom.operators.cluster import as_vectors, kmeans_sweep
from codeloom.operators.curate import curate, curation_counters
from codeloom.operators.dedup import by_normalized_body, by_text
from codeloom.operators.encode import EncodeOptions, encode, prepare, vocabulary, with_texts
from codeloom.operators.filters import of_first_authors, without_benchmark_names, without_excluded
from codeloom.operators.metrics import flatten_projects, function_type_metrics, project_records
from codeloom.operators.sample import exact_sample
from codeloom.operators import similarity
from codeloom.operators.similarity import corpus_similarity, pair_similarity
from codeloom.plans import views
from codeloom.schemas import FUNCTIONS


@pytest.fixture
def functions(spark):
    def build(*rows):
        full = []
        for i, r in enumerate(rows):
            base = dict(
                author="a", project="p", documentation="", signature="function f(x::Int)", body="x",
                inline_comments=[], file_path=f"f{i:03}", line_number=1, type="basic", module=None,
            )
            full.append(tuple({**base, **r}[f.name] for f in FUNCTIONS))
        return spark.createDataFrame(full, FUNCTIONS)

    return build


def test_first_copy_hides_later_ones(functions):
    df = functions({"signature": "function f(x)", "body": " x # no\n"}, {"body": "x # no"})
    assert curate(df).count() == 0
    row = curation_counters(df).first()
    assert (row["duplicates"], row["not_annotated"], row["kept"]) == (1, 1, 0)


def test_code_line_limit(functions):
    df = functions({"body": "x\n" * 24}, {"body": "y\n" * 25})
    assert [r["file_path"] for r in curate(df).collect()] == ["f000"]


def test_counters_add_up(spark, sf):
    df = views.code_functions(spark, sf)
    kept, counters = curate(df), curation_counters(df).first()
    split = {r["doc_quality"]: r["count"] for r in kept.groupBy("doc_quality").count().collect()}
    assert counters["total_functions"] == df.count()
    assert counters["kept"] == sum(split.values()) == counters["good_doc"] + counters["bad_doc"]
    assert (split["good"], split["bad"]) == (counters["good_doc"], counters["bad_doc"])


def test_published_figures(spark):
    row = curation_counters(views.code_functions(spark, "/root/testdata/sf0.01")).first()
    got = [row[c] for c in ("candidates", "duplicates", "not_annotated", "kept", "good_doc", "bad_doc")]
    assert got == [712, 47, 323, 212, 107, 105]


@pytest.mark.parametrize("dedup", [by_text, by_normalized_body])
def test_dedup_is_idempotent(spark, sf, dedup):
    once = dedup(views.code_functions(spark, sf))
    assert once.count() == dedup(once).count()


def test_dedup_keeps_borders_and_nulls_apart(functions):
    df = functions(
        {"documentation": "ab", "signature": "c"},
        {"documentation": "a", "signature": "bc"},
        {"documentation": None, "signature": "c"},
        {"documentation": "", "signature": "c"},
    )
    assert by_text(df).count() == 4


def test_hot_group_keeps_its_first_row(functions):
    df = functions(*[{"body": f"# {i}\nsame"} for i in range(300)], {"body": "other"}).repartition(8)
    assert sorted(r["file_path"] for r in by_normalized_body(df).collect()) == ["f000", "f300"]


def test_benchmark_names_go(spark, functions):
    prompts = spark.createDataFrame([('"""d"""\nfunction f(x)',), ("no function",)], "prompt string")
    df = functions({}, {"signature": "function g(x)"}, {"signature": "function ff(x)"})
    left = without_benchmark_names(df, prompts)
    assert sorted(r["signature"] for r in left.collect()) == ["function ff(x)", "function g(x)"]


def test_excluded_as_list_and_table(spark):
    repos = spark.createDataFrame([("a/b",), ("c/d",)], "name string")
    assert [r["name"] for r in without_excluded(repos, ["a/b"]).collect()] == ["c/d"]
    assert [r["name"] for r in without_excluded(repos, repos.where("name = 'a/b'")).collect()] == ["c/d"]


def test_first_authors(functions):
    df = functions(*[{"author": f"a{i:02}"} for i in range(15)])
    assert {r["author"] for r in of_first_authors(df).collect()} == {f"a{i:02}" for i in range(10)}
    assert of_first_authors(df, None).count() == 15


def test_type_metrics_list_all_types(functions):
    rows = {r["type"]: r for r in function_type_metrics(functions({"documentation": "d"}, {"type": "odd"})).collect()}
    assert (rows["basic"]["functions"], rows["basic"]["pct_documented"]) == (1, 100.0)
    assert (rows["anonymous"]["functions"], rows["anonymous"]["pct_commented"]) == (0, 0.0)


@pytest.mark.parametrize("parts", [1, 4])
def test_project_records_round_trip(functions, parts):
    df = functions(*[{"project": "big"} for _ in range(20)], {"project": "small"})
    records = project_records(df, parts)
    assert (records.where("project = 'big'").count() > 1) == (parts > 1)
    back = flatten_projects(records).select(*df.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_project_records_are_bounded_by_a_file(functions):
    df = functions(*[{"project": "big", "file_path": f"f{i // 2}", "line_number": i} for i in range(40)], {"project": "small"})
    records = project_records(df)
    big = records.where("project = 'big'").select(F.size("functions").alias("n"), "functions.file_path").collect()
    assert [r.n for r in big] == [2] * 20 and all(len(set(r.file_path)) == 1 for r in big)
    rows = [str(r) for r in flatten_projects(records).select(*df.columns).collect()]
    assert sorted(rows) == sorted(str(r) for r in df.collect())


@pytest.mark.parametrize("fraction", [0.0, 0.005, 0.1, 0.35, 0.5, 0.999, 1.0])
def test_sample_size_is_exact(spark, sf, fraction):
    df = views.code_functions(spark, sf)
    sample = exact_sample(df, fraction)
    assert sample.count() == round(df.count() * fraction)
    smaller = exact_sample(df, fraction / 2)
    assert smaller.join(sample, ["author", "project", "file_path"], "left_anti").count() == 0


def test_sample_of_nothing(functions):
    assert exact_sample(functions({}).where("false"), 0.5).count() == 0


def exact_p(b, c):
    n, m = b + c, min(b, c)
    return float(min(Fraction(1), 2 * Fraction(sum(math.comb(n, k) for k in range(m + 1)), 2**n)))


@pytest.mark.parametrize(
    "b, c", [(3, 10), (25, 25), (100, 140), (0, 0), (0, 7), (1, 0), (999, 1100), (1001, 1100), (5000, 5300), (9, 299)]
)
def test_mcnemar(value, b, c):
    p = value(mcnemar_p_value(F.lit(b).cast("bigint"), F.lit(c).cast("bigint")))
    assert p == pytest.approx(exact_p(b, c), rel=1e-9)


def test_mcnemar_of_billions(value):
    # A difference of two standard deviations.
    n, gap = 4 * 10**9, 63_246
    p = value(mcnemar_p_value(F.lit(n // 2 - gap).cast("bigint"), F.lit(n // 2 + gap).cast("bigint")))
    assert p == pytest.approx(math.erfc(2 * gap / math.sqrt(n) / math.sqrt(2)), rel=1e-4)


def test_mcnemar_below_any_double(spark):
    a, b = ([(f"p{i}", passed) for i in range(1200)] for passed in (True, False))
    row = evaluate.mcnemar(*runs(spark, a, b)).first()
    assert row["p_value"] == 0 and row["log10_p"] == pytest.approx(-1199 * math.log10(2), rel=1e-12)


@pytest.mark.parametrize("n, c, k, expected", [(10, 3, 1, 0.3), (10, 3, 5, 0.916667), (10, 0, 1, 0), (2, 1, 5, 1)])
def test_pass_at_k(value, n, c, k, expected):
    assert value(pass_rate(F.lit(n), F.lit(c), k)) == pytest.approx(expected, abs=1e-6)


def runs(spark, a, b):
    return [spark.createDataFrame(r, "problem string, passed boolean") for r in (a, b)]


def test_contingency(spark):
    a, b = runs(spark, [("x", True), ("y", True), ("z", False)], [("z", True), ("x", True), ("y", False)])
    assert tuple(evaluate.contingency(a, b).first()) == (1, 1, 1, 0)


@pytest.mark.parametrize("b", [[("x", True)], [("x", True), ("w", True)], [("x", True), ("y", True), ("y", True)]])
def test_pairing_fails_loudly(spark, b):
    with pytest.raises(PySparkException, match="not exactly one result"):
        evaluate.contingency(*runs(spark, [("x", True), ("y", True)], b)).collect()


def test_encoding(spark, functions):
    rows = with_texts(functions({"documentation": "a b b b", "body": "x y"}))
    words = vocabulary(rows, "complete_function", 3)
    ids = {r["token"]: r["id"] for r in words.collect()}
    assert ids["<|endoftext|>"] == 0 and ids["<|unk|>"] == 1 and ids['"'] == 2
    r = encode(rows, words, EncodeOptions(max_length=40)).first()
    assert len(r["input_ids"]) == len(r["attention_mask"]) == 40 and r["labels"] == r["input_ids"]
    used = sum(r["attention_mask"])
    assert r["input_ids"][0] == 0 and r["input_ids"][1:4] == [2, 2, 2] and r["input_ids"][used - 1] == 0
    cut = encode(rows, words, EncodeOptions(max_length=4)).first()
    assert cut["input_ids"] == [0, 2, 2, 2] and cut["attention_mask"] == [1] * 4
    simple = encode(rows, words, EncodeOptions(max_length=8, simple_input=True)).first()
    assert simple["labels"][3:] == [0] * 5


@pytest.mark.parametrize("size", [0, 1, 7, 40, 100])
def test_vocabulary_takes_the_most_frequent(spark, size):
    words = [f"w{i}" for i in range(60) for _ in range(1 + 40 // (i + 1))]
    texts = spark.createDataFrame([(" ".join(words),), ("",), (None,)], "text string")
    got = [(r["token"], r["id"]) for r in vocabulary(texts, "text", size).orderBy("id").collect()]
    first = sorted(set(words), key=lambda w: (-words.count(w), w))[:size]
    markers = len(got) - len(first)
    assert got[markers:] == [(w, markers + i) for i, w in enumerate(first)]


def test_rows_with_equal_keys_are_encoded_each(functions):
    rows = with_texts(functions({"body": "a b"}, {"body": "a b"}, {"body": "c"})).withColumn("file_path", F.lit("same"))
    out = encode(rows, vocabulary(rows, "complete_function", 50), EncodeOptions(max_length=64))
    assert out.columns == [*rows.columns, "input_ids", "attention_mask", "labels"]
    got = [(r["body"], tuple(r["input_ids"])) for r in out.collect()]
    assert sorted(b for b, _ in got) == ["a b", "a b", "c"] and len(set(got)) == 2


def test_prepare_order(spark, functions):
    prompts = spark.createDataFrame([("function z(x)",)], "prompt string")
    doc = " ".join(["word"] * 12)
    df = functions(
        {"documentation": doc},
        {"documentation": doc},
        {"documentation": "f(x)", "body": "short doc after the call went"},
        {"documentation": doc, "project": "HumanEval.jl", "body": "b"},
        {"documentation": doc, "body": "@testset"},
        {"documentation": doc, "signature": "function testing(x)"},
        {"documentation": doc, "body": "w " * 2100},
        {"documentation": doc, "signature": "function z(x)"},
    )
    assert [r["file_path"] for r in prepare(df, prompts).collect()] == ["f000"]


def test_pair_similarity(spark):
    pairs = spark.createDataFrame(
        [("same", "a b c d e", "a b c d e"), ("none", "a b", "c d"), ("empty", "", "a"), ("half", "a a a a b", "a a b c d")],
        "id string, candidate string, reference string",
    )
    nothing = spark.createDataFrame([], "n int, gram string")
    got = {r["id"]: r for r in pair_similarity(pairs, nothing).collect()}
    assert got["same"]["score"] == pytest.approx(1.0)
    assert got["none"]["score"] == 0 and got["empty"]["score"] == 0
    assert (got["half"]["matched_1"], got["half"]["total_1"]) == (3, 5)
    trivial = spark.createDataFrame([(1, "a")], "n int, gram string")
    assert {r["id"]: r["total_1"] for r in pair_similarity(pairs, trivial).collect()}["half"] == 1


def test_pair_partitions_grow_with_the_texts(spark, monkeypatch):
    rows = [(f"p{i}", "a b c " * i, "a c b " * 20) for i in range(1, 40)] + [("null", None, None)]
    pairs = spark.createDataFrame(rows, "id string, candidate string, reference string")
    nothing = spark.createDataFrame([], "n int, gram string")
    few = pair_similarity(pairs, nothing)
    monkeypatch.setattr(similarity, "PAIRED", 100)
    many = pair_similarity(pairs, nothing)
    size = sum(len(c) + len(r) for _, c, r in rows if c)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert f", {size // 100})" in plan(many) and f", {size // 100})" not in plan(few)
    assert sorted(few.collect()) == sorted(many.collect()) and len(rows) == many.count()


def test_corpus_similarity(spark):
    rows = [(1, "a a b"), (2, "a c"), (3, "z"), (4, ""), (5, None)]
    texts = spark.createDataFrame(rows, "id int, text string")

    def got(m):
        return {r["id"]: (r["matched"], r["total"]) for r in corpus_similarity(texts, "id", "text", m, 1).collect()}

    assert got(0) == {1: (1, 3), 2: (1, 2), 3: (0, 1), 4: (0, 0), 5: (0, 0)}
    # The first of the n-grams with the m-th total goes, ties by name: a, then b of b, c, z.
    assert got(2) == {1: (0, 0), 2: (0, 1), 3: (0, 1), 4: (0, 0), 5: (0, 0)}


def test_corpus_similarity_takes_the_highest_count_of_the_others(spark):
    texts = [["x"] * n for n in (5, 3, 3, 2, 1)] + [["y"] * n for n in (4, 4)] + [["w", "w"]]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["matched"] for r in corpus_similarity(frame, "id", "text", 0, 1).collect()}
    best = [max([u.count(w) for j, u in enumerate(texts) if j != i for w in t[:1]]) for i, t in enumerate(texts)]
    assert got == {i: min(len(t), b) for i, (t, b) in enumerate(zip(texts, best))}


def test_kmeans_sweep(spark, sf):
    rows = kmeans_sweep(as_vectors(spark.read.parquet(f"{sf}/embeddings.parquet")), ks=[2, 5, 10]).collect()
    assert [r["k"] for r in rows] == [2, 5, 10]
    assert rows[0]["inertia"] > rows[2]["inertia"] > 0
    assert all(-1 <= r["silhouette"] <= 1 and r["calinski_harabasz"] > 0 for r in rows)
