"""Zip archives of source trees.

An archive of any size is read by many tasks: the first step lists members from
the archive's directory, with the place of each; the second spreads ranges of
places and reads members there, without the directory. Paths may be anything
Arrow's file systems open.
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.schemas import FILES, PROJECTS
from codeloom.session import partitioned
from codeloom.sources.readers import LISTED, MAX_FILE_BYTES
from codeloom.sources.storage import in_batches, locate

#: Bytes of an archive whose members one task reads, opening the archive once.
RANGE_BYTES = 1 << 26
MEMBER = "archive string, path string, size bigint, place bigint, packed bigint, method int, flags int, crc bigint"

# The header before each member, of which only the lengths of the
# name and of the extra field are needed.
LOCAL_HEADER, LOCAL_MARK = struct.Struct("<4s22xHH"), b"PK\x03\x04"

# ------------------------------------------------------------------------------


def _open(uri: str):
    system, path = locate(uri)
    return system.open_input_file(path)


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in MEMBER.split(", ")]
    for batch in batches:
        for uri in batch["archive"]:
            with _open(uri) as file, zipfile.ZipFile(file) as archive:
                members = [
                    (uri, i.filename, i.file_size, i.header_offset, i.compress_size, i.compress_type, i.flag_bits, i.CRC)
                    for i in archive.infolist()
                    if not i.is_dir()
                ]
            for at in range(0, len(members), LISTED):
                yield pd.DataFrame(members[at : at + LISTED], columns=names)


def _member(file, row) -> bytes:
    """The content of one member, checked against its sum."""
    file.seek(row.place)
    mark, name, extra = LOCAL_HEADER.unpack(file.read(LOCAL_HEADER.size))
    if mark != LOCAL_MARK:
        raise zipfile.BadZipFile(f"no member at {row.place}: {row.archive}")
    file.seek(row.place + LOCAL_HEADER.size + name + extra)
    info = zipfile.ZipInfo(row.path)
    info.file_size, info.compress_size, info.CRC = row.size, row.packed, row.crc
    info.compress_type, info.flag_bits = row.method, row.flags
    if info.flag_bits & 1:
        raise RuntimeError(f"{row.path} is encrypted: {row.archive}")
    return zipfile.ZipExtFile(file, "r", info).read()


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def contents() -> Iterator[tuple[str, bytes]]:
        file, uri = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.archive != uri:
                    if file is not None:
                        file.close()
                    file, uri = _open(row.archive), row.archive
                yield row.path, _member(file, row)
        if file is not None:
            file.close()

    return in_batches(contents())


def list_members(spark: SparkSession, archives: list[str] | DataFrame) -> DataFrame:
    """``(archive, path, size)`` and the place of all files in the archives."""
    if not isinstance(archives, DataFrame):
        archives = spark.createDataFrame([(a,) for a in archives], "archive string")
    return partitioned(archives.select("archive"), "archive").mapInPandas(_list, MEMBER)


def read_archives(
    spark: SparkSession, archives: list[str] | DataFrame, keep: Column | None = None
) -> DataFrame:
    """``files(path, content)``; members that fail ``keep``, a test of ``path``, are never opened.

    Members are spread by ranges of their archive, so one archive with most of the
    files still fills the cluster, and a task opens an archive once a range.
    """
    members = list_members(spark, archives).where(F.col("size") <= MAX_FILE_BYTES)
    if keep is not None:
        members = members.where(keep)
    ranged = partitioned(members.withColumn("range", F.expr(f"place div {RANGE_BYTES}")), "archive", "range")
    return ranged.drop("range").sortWithinPartitions("archive", "place").mapInPandas(_read, FILES)


def read_oversized(spark: SparkSession, archives: list[str] | DataFrame) -> DataFrame:
    """``(path, reason)`` of members that no row can hold, for the table of rejects."""
    large = list_members(spark, archives).where(F.col("size") > MAX_FILE_BYTES)
    return large.select("path", F.lit("too large").alias("reason"))


def read_zipped_projects(
    spark: SparkSession, archives: list[str] | DataFrame, suffix: str = ".json", mode: str = "FAILFAST"
) -> DataFrame:
    """Nested project records from JSON members of archives, as ``readers.read_projects`` gives them from plain files.

    A member holds one array of records, or one record. Members are read in
    parallel, and one member is one row while it is parsed, so an export should
    have many members or be written as Parquet once.
    """
    files = read_archives(spark, archives, F.endswith("path", F.lit(suffix)))
    records = F.from_json(F.col("content").cast("string"), T.ArrayType(PROJECTS), {"mode": mode})
    return files.select(F.inline(records))
