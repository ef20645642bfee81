"""The registered queries: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as t
from codeloom.functions.tokens import count_tokens
from codeloom.operators import filters as p
from codeloom.operators import similarity
from codeloom.operators.cluster import as_vectors, dispersion, kmeans_checks, kmeans_sweep, silhouette
from codeloom.operators.curate import curate, curation_counters
from codeloom.operators.dedup import by_normalized_body, by_text
from codeloom.operators.encode import (
    EncodeOptions,
    encode,
    encode_prepared_rows,
    is_encodable,
    prepare,
    vocabulary,
    with_texts,
)
from codeloom.operators.evaluate import (
    contingency,
    in_problem_order,
    mcnemar,
    paired,
    pass_at_k,
    result_rows,
    sample_rows,
)
from codeloom.operators.extract import extract_functions, segments
from codeloom.operators.extract_syntax import extract_by_syntax
from codeloom.operators.metrics import (
    corpus_totals,
    flatten_projects,
    function_type_metrics,
    project_records,
    stage_audit,
)
from codeloom.operators.sample import exact_sample
from codeloom.operators.similar import similar_classes
from codeloom.plans import views as v
from codeloom.plans.append import append_new, corpus_rows
from codeloom.schemas import KEY
from codeloom.session import materialize, shared_folder
from codeloom.sources.writers import rejects

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ID = ["author", "project", "file_path"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(array: Column) -> Column:
    return F.array_join(array, "|")


# Curation ---------------------------------------------------------------------


@query
def curate_quality_split(spark, sf):
    kept = curate(v.code_functions(spark, sf))
    return kept.groupBy("project", "doc_quality").agg(F.count(F.lit(1)).alias("functions"))


@query
def curated_functions(spark, sf):
    return curate(v.code_functions(spark, sf)).select(*KEY, "doc_quality", F.md5("body").alias("body_md5"))


@query
def curate_counters(spark, sf):
    return curation_counters(v.code_functions(spark, sf))


@query
def dedup_normalized_body(spark, sf):
    return by_normalized_body(v.code_functions(spark, sf)).select(*KEY)


@query
def dedup_across_runs(spark, sf):
    """Documented functions come in a first run, all others in a second."""
    corpus = f"{shared_folder(spark).rstrip('/')}/appended-{uuid.uuid4().hex}"
    documented = F.coalesce(F.col("documentation"), F.lit("")) != ""
    functions = v.code_functions(spark, sf)
    append_new(functions.where(documented), corpus, 0)
    append_new(functions.where(~documented), corpus, 1)
    return corpus_rows(spark, corpus).select(*KEY, F.col("batch").cast("long").alias("batch"))


@query
def dedup_doc_sig_body(spark, sf):
    return by_text(v.code_functions(spark, sf)).select(*KEY)


@query
def decontaminate_names(spark, sf):
    documented = v.code_functions(spark, sf).where(p.is_documented_basic())
    return p.without_benchmark_names(documented, v.prompts(spark, sf)).select(*KEY, "signature")


@query
def documented_basic(spark, sf):
    return v.code_functions(spark, sf).where(p.is_documented_basic()).select(*KEY)


@query
def project_exclusion(spark, sf):
    kept = v.code_functions(spark, sf).where(p.outside_benchmark(F.col("project")))
    return kept.groupBy("project").agg(F.count(F.lit(1)).alias("functions"))


@query
def test_function_filters(spark, sf):
    return v.code_functions(spark, sf).select(
        *KEY,
        p.names_test_function(F.col("signature")).alias("names_test"),
        p.signature_has_test(F.col("signature")).alias("has_test"),
        p.has_testset(F.col("body")).alias("testset"),
    )


@query
def short_annotated(spark, sf):
    short = t.count_code_lines(F.col("body")) < p.MAX_CODE_LINES
    return v.code_functions(spark, sf).where(t.is_annotated(F.col("signature")) & short).select(*KEY)


@query
def project_regroup(spark, sf):
    records = project_records(v.code_functions(spark, sf), parts=3)
    line = F.transform("functions", lambda f: F.concat_ws(":", f["file_path"], F.md5(f["body"])))
    return records.select(
        "author",
        "project",
        F.col("part").cast("bigint").alias("part"),
        F.size("functions").cast("bigint").alias("functions"),
        F.md5(joined(line)).alias("content_md5"),
    )


@query
def projects_flattened(spark, sf):
    flat = flatten_projects(project_records(v.code_functions(spark, sf)))
    return flat.select(*KEY, F.md5("signature").alias("signature_md5"))


# Corpus figures ---------------------------------------------------------------


@query
def totals(spark, sf):
    return corpus_totals(v.code_functions(spark, sf))


@query
def function_types(spark, sf):
    commented = v.code_functions(spark, sf).withColumn("inline_comments", t.hash_comments(F.col("body")))
    return function_type_metrics(commented).select(
        "type",
        "functions",
        F.round("pct_documented", 6).alias("pct_documented"),
        F.round("pct_commented", 6).alias("pct_commented"),
    )


@query
def encode_audit(spark, sf):
    stages = [
        ("outside benchmark", p.outside_benchmark(F.col("project"))),
        ("documented basic", p.is_documented_basic()),
        ("no test set", ~p.has_testset(F.col("body"))),
        ("no test function", ~p.names_test_function(F.col("signature"))),
    ]
    return stage_audit(v.code_functions(spark, sf), stages)


@query
def distinct_authors(spark, sf):
    return v.code_functions(spark, sf).select("author").distinct()


# Text rules -------------------------------------------------------------------


@query
def newline_unify(spark, sf):
    raw = F.replace("text", F.lit(". "), F.lit(".\r\n"))
    raw = F.replace(raw, F.lit(","), F.lit("\r"))
    return v.documents(spark, sf).select("doc_id", F.md5(t.unify_newlines(raw)).alias("text_md5"))


@query
def comment_cleanup(spark, sf):
    return v.code_functions(spark, sf).select(*ID, F.md5(t.drop_empty_comments(F.col("body"))).alias("body_md5"))


@query
def body_normalized(spark, sf):
    return v.code_functions(spark, sf).select(*ID, F.md5(t.normalize_body(F.col("body"))).alias("body_md5"))


@query
def code_line_counts(spark, sf):
    return v.code_functions(spark, sf).select(*ID, t.count_code_lines(F.col("body")).cast("bigint").alias("code_lines"))


@query
def function_names(spark, sf):
    return v.code_functions(spark, sf).select(
        *ID,
        t.plain_name(F.col("signature")).alias("plain_name"),
        t.searched_name(F.col("signature")).alias("searched_name"),
        t.leading_name(F.col("signature")).alias("leading_name"),
        t.is_annotated(F.col("signature")).alias("annotated"),
        p.is_standard_signature(F.col("signature")).alias("standard"),
    )


@query
def good_doc_flags(spark, sf):
    return v.code_functions(spark, sf).select(*ID, t.has_good_doc(F.col("documentation"), F.col("signature")).alias("good_doc"))


@query
def doc_strip_signature(spark, sf):
    return v.code_functions(spark, sf).select(*ID, F.md5(t.strip_signature(F.col("documentation"), F.col("signature"))).alias("doc_md5"))


@query
def doc_first_line(spark, sf):
    return v.code_functions(spark, sf).select(*ID, t.first_line(F.col("documentation")).alias("first_line"))


@query
def doc_wrapped(spark, sf):
    doc = F.replace(F.col("documentation"), F.lit(" "), F.lit("----"))
    return v.code_functions(spark, sf).select(
        *ID,
        F.md5(t.wrap_doc(doc)).alias("kept_md5"),
        F.md5(t.wrap_doc(doc, strip_rules=True)).alias("stripped_md5"),
    )


@query
def prompt_names(spark, sf):
    return v.prompts(spark, sf).select("item_id", t.prompt_name(F.col("prompt")).alias("name"))


@query
def complete_functions(spark, sf):
    return with_texts(v.code_functions(spark, sf)).select(
        *ID,
        F.md5("simple_input").alias("input_md5"),
        F.md5("simple_output").alias("output_md5"),
        F.md5("complete_function").alias("complete_md5"),
    )


@query
def comment_split(spark, sf):
    parts = t.split_comment(F.replace("text", F.lit("e"), F.lit("#")))
    return v.documents(spark, sf).select(
        "doc_id",
        F.md5(parts["code"]).alias("code_md5"),
        F.size(parts["comments"]).cast("bigint").alias("comments"),
        F.md5(joined(parts["comments"])).alias("comments_md5"),
    )


@query
def inline_comments(spark, sf):
    return v.code_functions(spark, sf).select(
        *ID, joined(t.hash_comments(F.col("body"))).alias("marked"), joined(t.bare_comments(F.col("body"))).alias("bare")
    )


@query
def keyword_scrub(spark, sf):
    return v.code_functions(spark, sf).select(*ID, F.md5(t.scrub_keywords(F.col("body"))).alias("scrubbed_md5"))


@query
def rebuilt_functions(spark, sf):
    basic = v.code_functions(spark, sf).where(F.col("type") == "basic")
    return basic.select(*ID, F.md5(t.rebuild(F.col("signature"), F.col("body"))).alias("function_md5"))


# Files and repositories -------------------------------------------------------


@query
def source_paths(spark, sf):
    path = F.col("path")
    return v.page_files(spark, sf).select(
        "page_id",
        t.path_part(path, 0).alias("author"),
        t.path_part(path, 1).alias("project"),
        p.is_kept_source(path).alias("kept"),
        p.is_project_source(path).alias("project_source"),
    )


@query
def long_file_gate(spark, sf):
    content = F.col("content")
    return v.code_files(spark, sf).select(
        "path",
        t.count_lines(content).cast("bigint").alias("lines"),
        p.fits_line_limit(content).alias("fits"),
        p.fits_line_limit(content, 30).alias("fits_30"),
    )


@query
def utf8_gate(spark, sf):
    raw = F.when(F.col("doc_id") % 9 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(
        F.encode("text", "UTF-8")
    )
    return v.documents(spark, sf).where(p.is_utf8(raw)).select("doc_id")


def _damaged_files(spark, sf):
    """Source files, some without their last ``end``, some not UTF-8."""
    closed = (F.length("path") % 4 == 0) & F.endswith("content", F.lit("\nend\n"))
    cut = F.when(closed, F.expr("left(content, length(content) - 4)")).otherwise(F.col("content"))
    raw = F.encode(cut, "UTF-8")
    broken = F.when(F.endswith("path", F.lit("7.jl")), F.concat(raw, F.unhex(F.lit("C0")))).otherwise(raw)
    return v.code_files(spark, sf).select("path", broken.alias("content"))


@query
def rejected_files(spark, sf):
    return rejects(_damaged_files(spark, sf), limit=60)


@query
def rejects_by_reason(spark, sf):
    return rejected_files(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


@query
def file_count(spark, sf):
    kept = v.page_files(spark, sf).where(p.is_kept_source(F.col("path")))
    return kept.agg(F.count(F.lit(1)).alias("files"))


def _repositories(spark, sf):
    listed = F.when(
        F.col("doc_id") % 40 == 0, F.element_at(F.array(*map(F.lit, p.EXCLUDED_REPOS)), F.lit(1))
    ).otherwise(F.concat_ws("/", F.lit("lang"), F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))))
    return v.table(spark, sf, "documents").select("doc_id", listed.alias("name"))


@query
def exclusion_anti(spark, sf):
    return p.without_excluded(_repositories(spark, sf)).select("name")


@query
def resume_anti(spark, sf):
    done = v.table(spark, sf, "labels").where("quality = 1")
    repos = _repositories(spark, sf)
    manifest = repos.join(done, "doc_id").select("name")
    return p.not_done(repos, manifest).select("name")


@query
def first_n_authors(spark, sf):
    by_lang = v.code_functions(spark, sf).withColumn("author", F.concat_ws("-", "author", "project"))
    return p.of_first_authors(by_lang).select("author", "file_path")


# Extraction -------------------------------------------------------------------


def _extracted(spark, sf, kind: str):
    found = extract_functions(v.code_files(spark, sf))
    return found.where(F.col("type") == kind).select(
        "file_path",
        F.col("line_number").cast("bigint").alias("line_number"),
        "signature",
        F.md5("documentation").alias("doc_md5"),
        F.md5("body").alias("body_md5"),
        joined(F.col("inline_comments")).alias("comments"),
    )


@query
def extract_basic(spark, sf):
    return _extracted(spark, sf, "basic")


@query
def extract_single_line(spark, sf):
    return _extracted(spark, sf, "single-line")


@query
def extract_anonymous(spark, sf):
    return _extracted(spark, sf, "anonymous")


@query
def extract_bundles(spark, sf):
    return extract_functions(v.code_bundles(spark, sf)).select(
        *KEY[:3],
        F.col("line_number").cast("bigint").alias("line_number"),
        "type",
        "signature",
        F.md5("documentation").alias("doc_md5"),
        F.md5("body").alias("body_md5"),
        joined(F.col("inline_comments")).alias("comments"),
    )


@query
def extract_balanced(spark, sf):
    found = extract_functions(v.code_bundles(spark, sf), end_rule="balanced")
    return found.where(F.col("type") == "basic").select(
        "file_path",
        F.col("line_number").cast("bigint").alias("line_number"),
        "signature",
        F.md5("body").alias("body_md5"),
    )


@query
def extract_syntax(spark, sf):
    return extract_by_syntax(v.code_bundles(spark, sf)).select(
        "file_path",
        F.col("line_number").cast("bigint").alias("line_number"),
        "type",
        "signature",
        F.md5("documentation").alias("doc_md5"),
        F.md5("body").alias("body_md5"),
        joined(F.col("inline_comments")).alias("comments"),
    )


@query
def extract_quoted(spark, sf):
    """Both ways that tell code from strings and comments, on files full of text."""
    files = v.quoted_files(spark, sf)
    balanced = extract_functions(files, end_rule="balanced").where(F.col("type") == "basic")
    ways = [balanced.withColumn("way", F.lit("balanced")), extract_by_syntax(files).withColumn("way", F.lit("syntax"))]
    columns = [
        "way",
        "file_path",
        F.col("line_number").cast("bigint").alias("line_number"),
        "signature",
        "module",
        F.md5("body").alias("body_md5"),
    ]
    return ways[0].select(*columns).unionByName(ways[1].select(*columns))


@query
def module_attribution(spark, sf):
    """A module around each file, and a definition after its end."""
    name = F.regexp_extract("path", r"(m[0-9]+)\.jl", 1)
    around = F.concat(F.lit("module "), name, F.lit("\n"), "content", F.lit("end # "), name, F.lit("\nafter(x) = 1\n"))
    files = v.code_bundles(spark, sf).withColumn("content", around)
    return extract_functions(files).select(
        "file_path", "module", F.col("line_number").cast("bigint").alias("line_number")
    )


@query
def numbered_lines(spark, sf):
    lines = v.code_files(spark, sf).select("path", F.posexplode(t.lines(t.unify_newlines(F.col("content")))))
    return lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum((F.col("pos") + 1) * F.length("col")).alias("weight"),
    )


@query
def bundle_segments(spark, sf):
    """Segments put back together give the file."""
    parts = segments(F.col("content"))
    return v.code_bundles(spark, sf).select("path", F.md5(F.array_join(parts, "")).alias("content_md5"))


# Encoding ---------------------------------------------------------------------


@query
def token_counts(spark, sf):
    return v.documents(spark, sf).select("doc_id", count_tokens(F.col("text")).cast("bigint").alias("tokens"))


@query
def token_gate(spark, sf):
    return with_texts(v.code_functions(spark, sf)).where(is_encodable()).select(*KEY)


@query
def vocab_build(spark, sf):
    words = vocabulary(with_texts(v.code_functions(spark, sf)), "complete_function", 500)
    return words.select("token", "n", F.col("id").cast("bigint").alias("id"))


def _encoded(spark, sf, options: EncodeOptions):
    rows = materialize(with_texts(v.code_functions(spark, sf)).where(is_encodable()), "encodable")
    words = vocabulary(rows, "complete_function", options.vocabulary_size)
    return _digests(encode(rows, words, options))


def _digests(encoded):
    return encoded.select(
        *KEY,
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("used"),
        F.md5(joined(F.col("input_ids"))).alias("ids_md5"),
        F.md5(joined(F.col("labels"))).alias("labels_md5"),
    )


@query
def encode_padded(spark, sf):
    return _encoded(spark, sf, EncodeOptions(vocabulary_size=500, max_length=256))


@query
def encode_simple(spark, sf):
    return _encoded(spark, sf, EncodeOptions(vocabulary_size=500, max_length=128, simple_input=True))


def _prepared(spark, sf, options: EncodeOptions):
    rows = prepare(v.code_functions(spark, sf), v.prompts(spark, sf), options)
    return rows.select(*KEY, F.md5("complete_function").alias("complete_md5"))


@query
def encode_prepared(spark, sf):
    return _prepared(spark, sf, EncodeOptions())


@query
def encode_prepared_sampled(spark, sf):
    return _prepared(spark, sf, EncodeOptions(first_line=True, fraction=0.35, min_doc_tokens=5))


@query
def encode_corpus(spark, sf):
    """The whole job but for the written result: prepare, count the vocabulary, encode."""
    options = EncodeOptions(vocabulary_size=500, max_length=256)
    rows = prepare(v.code_functions(spark, sf), v.prompts(spark, sf), options)
    return _digests(encode_prepared_rows(rows, options))


@query
def exact_sample_35(spark, sf):
    return exact_sample(v.code_functions(spark, sf), 0.35).select(*KEY)


@query
def embedding_subset(spark, sf):
    return exact_sample(v.table(spark, sf, "embeddings"), 0.1, key=["vec_id"]).select("vec_id")


# Evaluation -------------------------------------------------------------------


@query
def results_extract(spark, sf):
    rows = in_problem_order(result_rows(v.result_documents(spark, sf)))
    return rows.select(
        "problem",
        t.problem_number(F.col("problem")).alias("number"),
        "passed",
        F.md5("prompt").alias("prompt_md5"),
        F.md5("prediction").alias("prediction_md5"),
    )


def _runs(spark, sf):
    labels = v.table(spark, sf, "labels")
    problem = F.concat(F.lit("Problem_"), F.col("doc_id").cast("string"))
    return tuple(
        labels.select(problem.alias("problem"), (F.col(c) == 1).alias("passed")) for c in ("quality", "toxic")
    )


@query
def paired_results(spark, sf):
    return paired(*_runs(spark, sf))


@query
def paired_contingency(spark, sf):
    return contingency(*_runs(spark, sf))


@query
def mcnemar_exact(spark, sf):
    return mcnemar(*_runs(spark, sf)).select(
        "a", "b", "c", "d", F.round("p_value", 9).alias("p_value"), F.round("log10_p", 6).alias("log10_p")
    )


@query
def benchmark_pass_at_k(spark, sf):
    """Turns of a conversation are the programs of one problem."""
    documents = v.result_documents(spark, sf).withColumn("name", F.regexp_replace("name", "[0-9]{2}_x$", ""))
    rates = pass_at_k(sample_rows(documents), [1, 2, 5])
    return rates.select("problems", *[F.round(f"pass_at_{k}", 6).alias(f"pass_at_{k}") for k in (1, 2, 5)])


# Similarity and clusters ------------------------------------------------------


@query
def trivial_ngrams(spark, sf):
    return similarity.trivial_ngrams(v.code_functions(spark, sf), "body", 100).select(
        F.col("n").cast("bigint").alias("n"), "gram", "count"
    )


@query
def ngram_pair_similarity(spark, sf):
    pairs = result_rows(v.result_documents(spark, sf)).select(
        F.col("problem").alias("id"), F.col("prediction").alias("candidate"), F.col("prompt").alias("reference")
    )
    trivial = similarity.trivial_ngrams(v.conversations(spark, sf), "text", 50)
    return similarity.pair_similarity(pairs, trivial).select(
        "id",
        *[F.col(f"{s}_{n}").cast("bigint").alias(f"{s}_{n}") for n in range(1, 5) for s in ("matched", "total")],
        F.round("score", 6).alias("score"),
    )


@query
def ngram_corpus_similarity(spark, sf):
    texts = v.code_functions(spark, sf).select(F.concat_ws("/", *ID).alias("id"), "body")
    return similarity.corpus_similarity(texts, "id", "body", 100).select(
        "id",
        F.col("matched").cast("bigint").alias("matched"),
        F.col("total").cast("bigint").alias("total"),
        F.round("shared", 6).alias("shared"),
    )


@query
def similar_functions(spark, sf):
    """Functions whose bodies are similar, in classes."""
    texts = v.code_functions(spark, sf).select(F.concat_ws("/", *ID).alias("id"), "body")
    return similar_classes(texts, "id", "body")


def _labelled(spark, sf):
    return as_vectors(v.table(spark, sf, "embeddings")).withColumn("prediction", F.col("label").cast("double"))


@query
def calinski_harabasz_labels(spark, sf):
    return dispersion(_labelled(spark, sf)).select(
        "points",
        "clusters",
        F.round("inertia", 6).alias("inertia"),
        F.round("calinski_harabasz", 6).alias("calinski_harabasz"),
    )


@query
def silhouette_labels(spark, sf):
    value = silhouette(_labelled(spark, sf))
    return spark.createDataFrame([(round(value, 6),)], "silhouette double")


@query
def kmeans_quality_sweep(spark, sf):
    return kmeans_sweep(as_vectors(v.table(spark, sf, "embeddings")))


@query
def kmeans_assignments(spark, sf):
    """What holds for any seed: all points in a cluster, no cluster empty, every point at its nearest centre."""
    vectors = as_vectors(v.table(spark, sf, "embeddings"))
    checks = [kmeans_checks(vectors, k) for k in (2, 5, 10, 20)]
    return reduce(lambda a, b: a.unionByName(b), checks)
