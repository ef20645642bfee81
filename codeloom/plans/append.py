"""Functions added run by run to a corpus that keeps one row per normalised body.

The corpus is its own ledger: every row has ``body_hash``, and a later run reads
that column alone. As rows and hashes are one write, a broken run cannot leave
one without the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as t
from codeloom.operators.dedup import keep_first
from codeloom.streaming.ingest import write_batch


def append_new(functions: DataFrame, corpus: str, batch: int) -> DataFrame:
    """Write the rows whose body neither an earlier batch nor an earlier row has; returns the batch.

    Batches are numbered from 0 in the order of their runs. A run that ended
    early is done again under its number: it looks at smaller numbers only and
    takes the place of what it left. A null body counts as an empty one. An
    empty input writes an empty batch. One shuffle of rows: the hashes of the
    corpus meet them in the partitions that the first-row rule has made.
    """
    spark = functions.sparkSession
    body = F.coalesce(F.col("body"), F.lit(""))
    hashed = functions.withColumn("body_hash", t.text_hash(t.normalize_body(body)))
    fresh = keep_first(hashed, F.col("body_hash"))
    if batch > 0:
        known = spark.read.option("basePath", corpus).schema("body_hash BINARY, batch INT").parquet(corpus)
        fresh = fresh.join(known.where(F.col("batch") < batch).select("body_hash"), "body_hash", "left_anti")
    write_batch(fresh, corpus, batch)
    return spark.read.schema(fresh.schema).parquet(f"{corpus.rstrip('/')}/batch={batch}")


def corpus_rows(spark: SparkSession, corpus: str) -> DataFrame:
    """All batches, with their numbers."""
    return spark.read.parquet(corpus)
