"""First-wins deduplication.

Copies are found by a 256-bit hash, and the first row in key order stays. The
rank filter lets each task drop all but its own first row per hash before the
shuffle, so a text copied a billion times arrives as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as t
from codeloom.schemas import KEY


def keep_first(df: DataFrame, hash_: Column, order: list[str] = KEY) -> DataFrame:
    ranked = df.withColumn("_hash", hash_).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_hash").orderBy(*order))
    )
    return ranked.where(F.col("_rank") == 1).drop("_hash", "_rank")


def by_text(functions: DataFrame) -> DataFrame:
    """One row per (documentation, signature, body)."""
    return keep_first(
        functions, t.text_hash(F.col("documentation"), F.col("signature"), F.col("body"))
    )


def by_normalized_body(functions: DataFrame) -> DataFrame:
    """One row per body, whatever its comments, blank lines and indentation."""
    return keep_first(functions, t.text_hash(t.normalize_body(F.col("body"))))
