"""Readers with explicit schemas. JSON documents fail on malformed input unless told otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.session import partitioned
from codeloom.sources.storage import in_batches, locate

# Fixed values -----------------------------------------------------------------

SOURCE_SUFFIX = ".jl"
RESULT_GLOB = "*.results.json.gz"
#: A row holds one file, and Java arrays end here.
MAX_FILE_BYTES = 2**31 - 64
#: Entries of a folder that go back to Spark together.
LISTED = 10_000

# ------------------------------------------------------------------------------


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    """A CSV list of repositories, gzipped or not; only ``name`` is kept."""
    header = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return header.select(F.col("name").cast("string"))


def list_source_tree(spark: SparkSession, root: str, suffix: str = SOURCE_SUFFIX) -> DataFrame:
    """``(path, size)`` of the files below a folder, paths relative to it: ``author/project/...``.

    The driver lists the first level only. Tasks list each author's projects,
    which are then spread, so an author with most of them still fills the
    cluster. Spark's own file listing would skip names that start with ``_`` or
    ``.``, which are ordinary source files here.
    """
    system, base = locate(root)
    authors = [(i.path,) for i in system.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory]
    start = len(base.rstrip("/")) + 1

    def listed(recursive: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Whatever lies in a folder; ``size`` is null for a folder."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            system, _ = locate(root)
            for batch in batches:
                for folder in batch["path"]:
                    found = system.get_file_info(fs.FileSelector(folder, recursive=recursive))
                    for at in range(0, len(found), LISTED):
                        rows = [(i.path, i.size if i.is_file else None) for i in found[at : at + LISTED]]
                        frame = pd.DataFrame(rows, columns=["path", "size"])
                        yield frame.astype({"size": "Int64"})

        return run

    entry = "path string, size bigint"
    folders = partitioned(spark.createDataFrame(authors, "path string"), "path")
    level = folders.mapInPandas(listed(recursive=False), entry)
    below = partitioned(level.where("size is null").select("path"), "path").mapInPandas(listed(recursive=True), entry)
    files = level.unionByName(below).where(F.col("size").isNotNull() & F.endswith("path", F.lit(suffix)))
    return files.select(F.expr(f"substring(path, {start + 1})").alias("path"), "size")


def read_source_tree(spark: SparkSession, root: str, suffix: str = SOURCE_SUFFIX) -> DataFrame:
    """``files(path, content)`` below a folder.

    Files are spread by their own path, so an author with most of the files still
    fills the cluster.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = locate(root)

        def content(path: str) -> bytes:
            with system.open_input_file(f"{base.rstrip('/')}/{path}") as file:
                return file.read()

        return in_batches((path, content(path)) for batch in batches for path in batch["path"])

    small = list_source_tree(spark, root, suffix).where(F.col("size") <= MAX_FILE_BYTES)
    return partitioned(small.select("path"), "path").mapInPandas(read, schemas.FILES)


def read_oversized(spark: SparkSession, root: str, suffix: str = SOURCE_SUFFIX) -> DataFrame:
    """``(path, reason)`` of files that no row can hold, for the table of rejects; opens none."""
    large = list_source_tree(spark, root, suffix).where(F.col("size") > MAX_FILE_BYTES)
    return large.select("path", F.lit("too large").alias("reason"))


def read_projects(spark: SparkSession, path: str, lines: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Nested project records from JSON arrays, from JSON lines, or from Parquet.

    One JSON array is one task, however large; write such exports as Parquet or
    lines once, which split.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schemas.PROJECTS).parquet(path)
    return spark.read.json(path, schema=schemas.PROJECTS, multiLine=not lines, mode=mode)


def read_prompts(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Benchmark prompts, one JSON object per line."""
    return spark.read.json(path, schema=schemas.PROMPTS, mode=mode)


def read_result_documents(spark: SparkSession, root: str, mode: str = "FAILFAST") -> DataFrame:
    """All result documents below a folder, one gzipped JSON object per file."""
    return (
        spark.read.schema(schemas.RESULT_DOCUMENT)
        .option("multiLine", "true")
        .option("mode", mode)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", RESULT_GLOB)
        .json(root)
    )


def read_results(spark: SparkSession, path: str, lines: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """Exported result rows, reduced to ``problem`` and ``passed``.

    Records stand one per line or in an array on one line; an array that is
    spread over lines needs ``lines=False``.
    """
    rows = spark.read.json(path, schema=schemas.RESULTS, multiLine=not lines, mode=mode)
    return rows.select("problem", "passed")


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
