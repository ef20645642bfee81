"""Resumable ingest: each source file is extracted once, whatever interrupts the run.

Extraction is a narrow expression without state, so the stream needs neither a
watermark nor a shuffle. The checkpoint is the manifest of what is done. A batch
writes what it extracts and what it skips to folders that its number names, in
place of what a broken run of the same batch has left there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.extract import extract_functions
from codeloom.operators.filters import is_kept_source
from codeloom.plans.jobs import extractable
from codeloom.schemas import FILES
from codeloom.sources.writers import rejects as skipped


def write_batch(rows: DataFrame, folder: str, batch: int) -> None:
    """Idempotent: a repeated batch takes the place of its first, perhaps unfinished, copy."""
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")


def ingest_available(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    end_rule: str = "first",
    files_per_batch: int = 1000,
    rejects: str | None = None,
) -> int:
    """Extract all not yet seen tables of ``files(path, content)`` and stop; returns the number of batches.

    ``rejects`` names a table for ``(path, reason)`` of the source files that are
    skipped. A run that ends between the two writes leaves its batch open; the
    next run does it again, so each source file is in one of the tables, and its
    functions or its reason are there once. Both tables have a column ``batch``.
    """
    files = spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def one_batch(rows: DataFrame, batch: int) -> None:
        kept = rows.where(extractable(F.col("path"), F.col("content")))
        write_batch(extract_functions(kept, end_rule), target, batch)
        if rejects is not None:
            write_batch(skipped(rows.where(is_kept_source(F.col("path"))), unclosed=False), rejects, batch)

    before = _batches(spark, checkpoint)
    query = (
        files.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _batches(spark, checkpoint) - before


def _batches(spark: SparkSession, checkpoint: str) -> int:
    """Batches that the checkpoint has as done: they are numbered, and old entries are purged."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(checkpoint, "commits")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return 0
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return max((int(n) + 1 for n in names if n.isdigit()), default=0)
