"""Packing by powers of two.

Each document's ids, with an end id, are cut into full sequences and then into
one piece for each binary digit of the rest, longest first. Every piece is a
sequence of its own: none crosses documents, and none is padded, as every length
is a power of two. Sequences of one length form a bucket, from which batches of
equal shape can be read; the bucket is the highest part of ``sequence_id``.

A document is cut where it lies: no shuffle, and no key can become hot. Null and
empty texts are a document of the end id alone; repeated rows are packed each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bpe import encoder
from codeloom.llm.common import columns, map_rows, shared

#: Tokens of the longest sequence, a power of two.
LONGEST = 4096
END = 2
#: ``sequence_id``: 4 bits of bucket, 27 of partition, 32 of number.
NUMBER_BITS, PARTITION_BITS = 32, 27


def pieces(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n ids."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(
    docs: DataFrame, spec: str, longest: int = LONGEST, end: int = END, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``, a row for each piece.

    Numbers are given per partition of the input, in its order, so a task that
    runs again gives the same ones if the input is read from files.
    """
    if longest & (longest - 1) or not 0 < longest <= 1 << 15:
        raise ValueError("longest: a power of two, up to 32768")
    rows = columns(docs, doc_id=doc_id, text=text)
    kind, held = rows.schema["doc_id"].dataType.simpleString(), shared(docs, spec)
    last = np.array([end], "<u4").tobytes()

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        e, numbers = encoder(held.value), Counter()
        place = TaskContext.get().partitionId() << NUMBER_BITS
        for d, t in it:
            ids = e.ids(t or "") + last
            at, total = 0, len(ids) // 4
            for length in pieces(total, longest):
                bucket = length.bit_length() - 1
                sequence = bucket << (NUMBER_BITS + PARTITION_BITS) | place | numbers[bucket]
                numbers[bucket] += 1
                yield d, at, length, ids[4 * at : 4 * (at + length)], total, sequence, 0
                at += length

    return map_rows(
        rows,
        run,
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder for each length, so a trainer reads batches of one shape."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
