"""Corpus figures and the nested project records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.schemas import FUNCTION_FIELDS

# Fixed values -----------------------------------------------------------------

FUNCTION_TYPES = ["basic", "single-line", "anonymous"]

# ------------------------------------------------------------------------------


def corpus_totals(functions: DataFrame) -> DataFrame:
    """Distinct authors and projects and the number of functions.

    Counting per project first leaves one row per project for the distinct counts.
    """
    projects = functions.groupBy("author", "project").agg(F.count(F.lit(1)).alias("n"))
    authors = projects.groupBy("author").agg(F.count(F.lit(1)).alias("p"), F.sum("n").alias("n"))
    return authors.agg(
        F.count(F.lit(1)).alias("authors"),
        F.coalesce(F.sum("p"), F.lit(0)).cast("bigint").alias("projects"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("functions"),
    )


def function_type_metrics(functions: DataFrame) -> DataFrame:
    """Count, share documented and share commented, for each of the three types.

    A single global aggregate, unpivoted; absent types show as zeros.
    """
    cells, rows = [], []
    for i, kind in enumerate(FUNCTION_TYPES):
        of_kind = F.col("type") == kind
        documented = of_kind & (F.col("documentation") != "")
        commented = of_kind & (F.size("inline_comments") > 0)
        cells += [
            F.count_if(of_kind).alias(f"n{i}"),
            F.count_if(documented).alias(f"d{i}"),
            F.count_if(commented).alias(f"c{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(kind).alias("type"),
                F.col(f"n{i}").alias("functions"),
                _percent(F.col(f"d{i}"), F.col(f"n{i}")).alias("pct_documented"),
                _percent(F.col(f"c{i}"), F.col(f"n{i}")).alias("pct_commented"),
            )
        )
    return functions.agg(*cells).select(F.inline(F.array(*rows)))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0)) * 100)


def project_records(functions: DataFrame, parts: int | None = None) -> DataFrame:
    """Nested records: one for each file of a project, or ``parts`` for every project, as far as it has files for them.

    A file's lines are bounded, so a record of one file is too, however large its
    project; ``part`` is the file's hash then. With ``parts`` a file goes to a part
    by that hash, and the number must grow with the projects. The rule holds for
    all projects alike, so what a reader sees does not depend on a project's size.
    """
    bucket = F.conv(F.substring(F.md5(F.col("file_path")), 1, 8), 16, 10).cast("bigint")
    fields = [f.name for f in FUNCTION_FIELDS if f.name in functions.columns]
    record = F.struct("file_path", "line_number", F.struct(*fields).alias("function"))
    if parts is None:
        part, grain = bucket, ["author", "project", "part", "file_path"]
    else:
        part, grain = F.pmod(bucket, F.lit(parts)).cast("int"), ["author", "project", "part"]
    return (
        functions.withColumn("part", part)
        .groupBy(*grain)
        .agg(F.array_sort(F.collect_list(record)).alias("records"))
        .select("author", "project", "part", F.transform("records", lambda r: r["function"]).alias("functions"))
    )


def flatten_projects(projects: DataFrame) -> DataFrame:
    """Nested project records to flat functions; author and project stay."""
    return projects.select("author", "project", F.inline("functions"))


def stage_audit(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each predicate of a chain, from one pass."""
    passed, cells, out = F.lit(True), [F.count(F.lit(1)).alias("s0")], []
    for i, (name, condition) in enumerate(stages, 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        cells.append(F.count_if(passed).alias(f"s{i}"))
        out.append(
            F.struct(
                F.lit(i).cast("bigint").alias("step"),
                F.lit(name).alias("stage"),
                F.col(f"s{i - 1}").alias("rows_before"),
                F.col(f"s{i}").alias("rows_after"),
            )
        )
    return rows.agg(*cells).select(F.inline(F.array(*out)))
