"""Sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import filters as p
from codeloom.operators.encode import EncodeOptions
from codeloom.operators.evaluate import in_problem_order
from codeloom.operators.metrics import project_records


def write_projects(
    functions: DataFrame, path: str, as_json: bool = False, mode: str = "overwrite", parts: int | None = None
) -> None:
    """Nested project records as Parquet, or as JSON lines in UTF-8; one for each file, or ``parts`` for a project."""
    records = project_records(functions, parts)
    if as_json:
        records.write.mode(mode).option("encoding", "UTF-8").json(path)
    else:
        records.write.mode(mode).parquet(path)


def write_curated(curated: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One table, partitioned by documentation quality.

    All kept functions are the whole table; good and bad ones are its partitions,
    so no row is written twice.
    """
    curated.write.mode(mode).partitionBy("doc_quality").parquet(path)


def read_curated(spark: SparkSession, path: str, quality: str | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table if quality is None else table.where(F.col("doc_quality") == quality)


def write_files(files: DataFrame, path: str, mode: str = "append") -> None:
    """Cleaned source files as one compressed table."""
    kept = files.where(p.is_kept_source(F.col("path")))
    kept.write.mode(mode).option("compression", "zstd").parquet(path)


def rejects(files: DataFrame, limit: int = p.MAX_FILE_LINES, unclosed: bool = True) -> DataFrame:
    """``(path, reason)`` of the files that extraction skips; ``unclosed``: also for a function without an end.

    Exploding the one reason or none judges each file once; a filter on the
    reason would be pushed down and judge it twice.
    """
    reason = p.reject_reason(F.col("content"), limit, unclosed)
    return files.select("path", F.explode(F.array_compact(F.array(reason))).alias("reason"))


def write_results(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result rows as JSON, in problem order."""
    in_problem_order(rows).write.mode(mode).json(path)


def encoded_path(root: str, label: str, options: EncodeOptions, fingerprint: str) -> str:
    """Where the encoded table of these options and this input lies."""
    digest = hashlib.sha256(f"{fingerprint}|{options!r}".encode()).hexdigest()[:24]
    return f"{root.rstrip('/')}/{label}/{digest}"


def fingerprint(df: DataFrame) -> str:
    """Changes with the rows' number or content; one pass, no shuffle of rows."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum((h % 1_000_003)).alias("s")
    ).first()
    return f"{row['n']}-{row['x']}-{row['s']}"


def reuse_or_write(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False
) -> DataFrame:
    """The table at ``path`` if a run has finished it, which its marker tells, else build and write it."""
    if not force and _finished(spark, path):
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _finished(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
