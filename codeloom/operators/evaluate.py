"""Benchmark results: extraction, paired comparison, pass@k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import stats
from codeloom.functions import text as t

# Fixed values -----------------------------------------------------------------

PASSED_STATUS = "OK"

# ------------------------------------------------------------------------------


def result_rows(documents: DataFrame) -> DataFrame:
    """``(problem, prompt, prediction, passed)`` from the first program of each problem."""
    first = F.get(F.col("results"), F.lit(0))
    return documents.select(
        F.col("name").alias("problem"),
        "prompt",
        t.prediction(first["program"], F.col("prompt"), F.col("tests")).alias("prediction"),
        F.coalesce(first["status"] == PASSED_STATUS, F.lit(False)).alias("passed"),
    )


def in_problem_order(rows: DataFrame) -> DataFrame:
    """Sorted by the number in the problem's name."""
    return rows.orderBy(t.problem_number(F.col("problem")), "problem")


def sample_rows(documents: DataFrame) -> DataFrame:
    """``(problem, passed)`` of every program, for pass@k."""
    return documents.select(F.col("name").alias("problem"), F.explode("results").alias("r")).select(
        "problem", (F.col("r.status") == PASSED_STATUS).alias("passed")
    )


def paired(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """``(problem, passed_a, passed_b)``; fails on unmatched or repeated problems.

    Both runs go through one grouped aggregate, where a repeated problem collapses
    within its task, instead of a full outer join.
    """
    both = run_a.select("problem", "passed", F.lit("a").alias("run")).unionByName(
        run_b.select("problem", "passed", F.lit("b").alias("run"))
    )
    of_a, of_b = F.col("run") == "a", F.col("run") == "b"
    grouped = both.groupBy("problem").agg(
        F.count_if(of_a).alias("na"),
        F.count_if(of_b).alias("nb"),
        F.bool_or(of_a & F.col("passed")).alias("a"),
        F.bool_or(of_b & F.col("passed")).alias("b"),
    )
    complete = (F.col("na") == 1) & (F.col("nb") == 1)
    message = F.concat(F.lit("not exactly one result per run for problem "), F.col("problem"))

    def checked(c: str) -> Column:
        return F.when(complete, F.col(c)).otherwise(F.raise_error(message).cast("boolean"))

    return grouped.select("problem", checked("a").alias("passed_a"), checked("b").alias("passed_b"))


def contingency(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """One row: both passed, only the first, only the second, neither."""
    a, b = F.col("passed_a"), F.col("passed_b")
    return paired(run_a, run_b).agg(
        F.count_if(a & b).alias("a"),
        F.count_if(a & ~b).alias("b"),
        F.count_if(~a & b).alias("c"),
        F.count_if(~a & ~b).alias("d"),
    )


def mcnemar(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """The contingency table with the exact two-sided p-value and its decimal logarithm."""
    ln_p = stats.mcnemar_ln_p(F.col("b"), F.col("c"))
    return contingency(run_a, run_b).select("*", F.exp(ln_p).alias("p_value"), (ln_p / math.log(10)).alias("log10_p"))


def pass_at_k(samples: DataFrame, ks: list[int]) -> DataFrame:
    """Mean pass@k over the problems, one column per ``k``."""
    problems = samples.groupBy("problem").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("c")
    )
    return problems.agg(
        F.count(F.lit(1)).alias("problems"),
        *[F.avg(stats.pass_at_k(F.col("n"), F.col("c"), k)).alias(f"pass_at_{k}") for k in ks],
    )
