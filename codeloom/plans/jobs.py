"""Whole jobs, composed of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import path_part
from codeloom.operators import filters as p
from codeloom.operators.cluster import as_vectors, kmeans_sweep
from codeloom.operators.curate import curate, curation_counters
from codeloom.operators.encode import EncodeOptions, encode_prepared_rows, prepare
from codeloom.operators.evaluate import mcnemar, result_rows
from codeloom.operators.extract import extract_functions
from codeloom.operators.extract_syntax import extract_by_syntax
from codeloom.operators.metrics import corpus_totals, flatten_projects, function_type_metrics
from codeloom.operators.sample import exact_sample
from codeloom.sources import readers, writers


def extractable(path: Column, content: Column) -> Column:
    """Source files that are valid text and not too long; the path test comes first."""
    text = content.cast("string")
    return p.is_kept_source(path) & p.is_utf8(content) & p.fits_line_limit(text)


def build_corpus(
    files: DataFrame,
    target: str,
    end_rule: str = "first",
    first_authors: int | None = None,
    profile: str = "text",
    rejects: str | None = None,
    unread: DataFrame | None = None,
) -> DataFrame:
    """Source files to a table of functions; returns the table.

    ``profile``: ``"text"``, or ``"syntax"``, which also leaves out files with a
    function that nothing closes, files outside a project, and paths that speak of
    tests; the last two are neither extracted nor rejects. This profile and
    ``end_rule="balanced"`` reject files in which a string or comment never ends. Authors are capped by their files, before
    anything is extracted. ``rejects`` names a table for ``(path, reason)`` of
    the source files that are skipped; ``unread``, such as the readers'
    ``read_oversized``, has those that could not even become a row, of all authors.
    """
    if profile not in ("text", "syntax"):
        raise ValueError(f"unknown profile: {profile}")
    wanted, author = p.is_kept_source(F.col("path")), path_part(F.col("path"), 0)
    if profile == "syntax":
        wanted &= p.is_project_source(F.col("path"))
    files = p.of_first_authors(files.where(wanted).withColumn("author", author), first_authors)
    files = files.drop("author")
    lexed = profile == "syntax" or end_rule == "balanced"
    reason = p.reject_reason(F.col("content"), unclosed=profile == "syntax", lexed=lexed)
    if rejects is not None:
        skipped = files.select("path", F.explode(F.array_compact(F.array(reason))).alias("reason"))
        if unread is not None:
            skipped = skipped.unionByName(unread.where(wanted).select("path", "reason"))
        skipped.write.mode("overwrite").parquet(rejects)
    kept = files.where(reason.isNull())
    functions = extract_by_syntax(kept) if profile == "syntax" else extract_functions(kept, end_rule)
    functions.write.mode("overwrite").parquet(target)
    return files.sparkSession.read.parquet(target)


def corpus_report(functions: DataFrame) -> dict[str, DataFrame]:
    return {"totals": corpus_totals(functions), "types": function_type_metrics(functions)}


def curate_corpus(functions: DataFrame, target: str) -> DataFrame:
    """Write the curated functions; returns the counters of the run."""
    writers.write_curated(curate(functions), target)
    return curation_counters(functions)


def encode_corpus(
    functions: DataFrame,
    prompts: DataFrame,
    root: str,
    label: str = "words",
    options: EncodeOptions = EncodeOptions(),
    force: bool = False,
    input_version: str | None = None,
) -> DataFrame:
    """Encoded training examples, reused if the same input and options were encoded before.

    ``input_version`` names the state of the input, as a table version does.
    Without it the input is hashed, which reads it once.

    The vocabulary is counted on the prepared corpus. All columns of the functions
    stay beside the ids.
    """
    spark = functions.sparkSession
    version = input_version or f"{writers.fingerprint(functions)}|{writers.fingerprint(prompts)}"
    path = writers.encoded_path(root, label, options, version)

    def build() -> DataFrame:
        return encode_prepared_rows(prepare(functions, prompts, options), options)

    return writers.reuse_or_write(spark, path, build, force)


def export_results(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Collect result documents, write them in problem order, return the rows."""
    rows = result_rows(readers.read_result_documents(spark, source))
    writers.write_results(rows, target)
    return rows


def compare_runs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """McNemar's test on two exported result files, without the logarithm of its p-value."""
    return mcnemar(readers.read_results(spark, first), readers.read_results(spark, second)).drop("log10_p")


def explore_clusters(embeddings: DataFrame, key: str, fraction: float = 0.1, **options) -> DataFrame:
    """k-means figures on a seeded share of the embeddings."""
    return kmeans_sweep(as_vectors(exact_sample(embeddings, fraction, key=[key])), **options)


def functions_of(projects: DataFrame) -> DataFrame:
    """Flat functions of nested records, benchmark projects left out before the explosion."""
    return flatten_projects(projects.where(p.outside_benchmark(F.col("project"))))
