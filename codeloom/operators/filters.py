"""Predicates over repositories, files and functions, each a boolean Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as t
from codeloom.operators.extract import has_unclosed_function
from codeloom.operators.lexer import has_open_token, hide

# Fixed values -----------------------------------------------------------------

SOURCE_SUFFIX = ".jl"
TOOL_FOLDERS = [".git", ".github", ".vscode"]
EXCLUDED_REPOS = [
    "lanl-ansi/MINLPLib.jl",
    "Mehrnoom/Cryptocurrency-Pump-Dump",
    "Cheng-Lin-Li/Market-Trend-Prediction",
]
BENCHMARK_PROJECT = "HumanEval.jl"
MAX_FILE_LINES = 10_000
MAX_CODE_LINES = 25
MIN_DOC_TOKENS = 10
MAX_TOKENS = 2048
FIRST_AUTHORS = 10

# Files ------------------------------------------------------------------------


def is_kept_source(path: Column) -> Column:
    """A source file outside the tool folders at the top of a checkout."""
    folders = "|".join(f.replace(".", r"\.") for f in TOOL_FOLDERS)
    return F.endswith(path, F.lit(SOURCE_SUFFIX)) & ~F.rlike(path, F.lit(rf"^[^/]+/[^/]+/(?:{folders})/"))


def is_project_source(path: Column) -> Column:
    """A source file inside a project whose path does not speak of tests."""
    return (
        F.endswith(path, F.lit(SOURCE_SUFFIX))
        & ~F.contains(F.lower(path), F.lit("test"))
        & (F.size(F.split(path, "/", -1)) >= 3)
    )


def fits_line_limit(content: Column, limit: int = MAX_FILE_LINES) -> Column:
    return t.count_lines(content) <= limit


def is_utf8(content: Column) -> Column:
    """Checks the raw bytes; reading as text would repair them silently."""
    return F.is_valid_utf8(content.cast("string"))


def reject_reason(
    content: Column, limit: int = MAX_FILE_LINES, unclosed: bool = True, lexed: bool = False
) -> Column:
    """Why a source file is skipped, or null if it is not.

    ``unclosed``: functions must have an end; ``lexed``: so must strings with three quotes and block comments, and
    no function is looked for in them.
    """
    text = content.cast("string")
    reason = F.when(~is_utf8(content), "not utf-8").when(~fits_line_limit(text, limit), "too many lines")
    if lexed:
        text = t.unify_newlines(text)
        reason = reason.when(has_open_token(text), "unclosed string or comment")
        text = hide(text)
    return reason.when(has_unclosed_function(text), "unclosed function") if unclosed else reason


# Repositories and functions ---------------------------------------------------


def without_excluded(repos: DataFrame, excluded: list[str] | DataFrame = EXCLUDED_REPOS) -> DataFrame:
    """Drop listed repositories; a list too long for a predicate comes as a table."""
    if isinstance(excluded, DataFrame):
        return repos.join(excluded.select("name").distinct(), "name", "left_anti")
    return repos.where(~F.col("name").isin(excluded))


def not_done(repos: DataFrame, manifest: DataFrame) -> DataFrame:
    """Repositories that no earlier run has finished."""
    return repos.join(manifest.select("name").distinct(), "name", "left_anti")


def of_first_authors(df: DataFrame, n: int | None = FIRST_AUTHORS) -> DataFrame:
    """Rows of the first ``n`` authors by name; ``None`` keeps all.

    The right side has at most ``n`` rows, so the plan broadcasts it.
    """
    if n is None:
        return df
    return df.join(df.select("author").distinct().orderBy("author").limit(n), "author", "left_semi")


def outside_benchmark(project: Column) -> Column:
    return project != BENCHMARK_PROJECT


def is_documented_basic() -> Column:
    """A ``function name(`` of type ``basic`` with documentation."""
    return (
        t.searched_name(F.col("signature")).isNotNull()
        & (F.col("type") == "basic")
        & (F.length("documentation") > 0)
    )


def signature_has_test(signature: Column) -> Column:
    return F.contains(F.lower(signature), F.lit("test"))


def names_test_function(signature: Column) -> Column:
    return F.contains(F.lower(signature), F.lit("function test"))


def has_testset(body: Column) -> Column:
    return F.contains(body, F.lit("@testset"))


def is_standard_signature(signature: Column) -> Column:
    return F.startswith(t.strip(signature), F.lit("function"))


def without_benchmark_names(functions: DataFrame, prompts: DataFrame) -> DataFrame:
    """Drop functions that a benchmark prompt asks for by name.

    Prompts without a function are no names. The side is broadcast when its size
    allows it; beyond that the join shuffles and splits skewed names.
    """
    names = prompts.select(t.prompt_name(F.col("prompt")).alias("name")).where("name is not null").distinct()
    named = functions.withColumn("name", t.searched_name(F.col("signature")))
    return named.join(names, "name", "left_anti").drop("name")
