"""Curation: basic, annotated, short, unique functions, split by documentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as t
from codeloom.operators import filters as p
from codeloom.operators.dedup import keep_first
from codeloom.schemas import KEY


def is_candidate() -> Column:
    """What deduplication sees: an un-annotated first copy still hides later ones."""
    return (
        p.outside_benchmark(F.col("project"))
        & (F.col("type") == "basic")
        & ~p.signature_has_test(F.col("signature"))
    )


def _flagged(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        p.is_standard_signature(F.col("signature")).alias("standard"),
        t.is_annotated(F.col("signature")).alias("annotated"),
        t.has_good_doc(F.col("documentation"), F.col("signature")).alias("good_doc"),
    )


def curate(functions: DataFrame) -> DataFrame:
    """The kept functions with their cleaned bodies and a ``doc_quality`` column."""
    code = t.code_lines(F.col("body"))
    unique = keep_first(
        functions.where(is_candidate()).withColumn("_code", code), t.text_hash(F.array_join("_code", "\n"))
    )
    kept = unique.where(t.is_annotated(F.col("signature")) & (F.size("_code") < p.MAX_CODE_LINES))
    good = t.has_good_doc(F.col("documentation"), F.col("signature"))
    return kept.select(
        *[
            t.drop_empty_comments(F.col("body")).alias("body") if c == "body" else c
            for c in functions.columns
        ],
        F.when(good, "good").otherwise("bad").alias("doc_quality"),
    )


def curation_counters(functions: DataFrame) -> DataFrame:
    """All counters of a curation run in one scan and one shuffle.

    Rows that are no candidates share a null hash, and copies share theirs, so
    the partial aggregate sends one small row per hash and task: the hash, the
    first key with its flags, and a count. No text is shuffled.
    """
    code = t.code_lines(F.col("body"))
    rows = _flagged(functions.withColumn("_code", code)).select(
        F.when(is_candidate(), t.text_hash(F.array_join("_code", "\n"))).alias("hash"),
        F.struct(
            *KEY,
            "standard",
            "annotated",
            "good_doc",
            (F.size("_code") < p.MAX_CODE_LINES).alias("short"),
        ).alias("row"),
    )
    groups = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    unique = F.col("hash").isNotNull()
    kept = unique & F.col("first.annotated") & F.col("first.short")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    return groups.agg(
        total(F.col("n")).alias("total_functions"),
        total(F.when(unique, F.col("n"))).alias("candidates"),
        total(F.when(unique, F.col("n") - 1)).alias("duplicates"),
        F.count_if(unique & ~F.col("first.standard")).alias("non_standard_signatures"),
        F.count_if(unique & ~F.col("first.annotated")).alias("not_annotated"),
        F.count_if(kept).alias("kept"),
        F.count_if(kept & F.col("first.good_doc")).alias("good_doc"),
        F.count_if(kept & ~F.col("first.good_doc")).alias("bad_doc"),
    )
