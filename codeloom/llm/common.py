"""What several operators share."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run without ASCII white space; ``bytes.split`` splits UTF-8 in the same way.
SPACE = "\x20\x09-\x0d"
WORD = re.compile(f"[^{SPACE}]+")


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under fixed names, so that no other column of the input can clash."""
    return df.select(*[df[source].alias(name) for name, source in names.items()])


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``rows`` gets a partition's rows, and yields rows of ``schema``, which go back in batches of about 16 MB."""
    wanted = T.StructType.fromDDL(schema)
    names = wanted.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(wanted)

        def batch(held: list[tuple]) -> pa.RecordBatch:
            cells = list(zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, arrow)], names=names)

        held, size = [], 0
        for row in rows(_unpacked(batches)):
            held.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, str, list)))
            if size >= 1 << 24:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    return df.mapInArrow(run, wanted)


def _unpacked(batches: Iterator[pa.RecordBatch], step: int = 500) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield from zip(*[c.to_pylist() for c in part.columns])


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def hashed_sample(df: DataFrame, n: int, hashed: str, *order: str) -> DataFrame:
    """About ``n`` rows at most: those with the smallest hashes of a column, ties by ``order``.

    A threshold on the hash, set from the number of rows, leaves about 1.2 n rows before they are sorted, so the
    tasks together don't send more than that, however many they are.
    """
    total = df.count()
    share = min(1.0, 1.2 * n / total) if total else 1.0
    key = F.xxhash64(hashed)
    few = df if share == 1.0 else df.where(key <= F.lit(int(-(2**63) + share * (2**64 - 1))))
    return few.orderBy(key, *order).limit(n)


def shared(df: DataFrame, value):
    """A value of bounded size, sent once to each executor."""
    return df.sparkSession.sparkContext.broadcast(value)


@functools.cache
def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
