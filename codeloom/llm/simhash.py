"""Near-duplicates by SimHash, found with keys from the Golay code.

A fingerprint of 64 bits is cut into three segments. Two bits that differ leave
one segment untouched, and no segment has more than two errors. The perfect
Golay code maps each word of 23 bits to one codeword; the codewords of a word
and its neighbours at one bit are at most six, and two words that differ in two
bits share one of them, as the word half-way is a neighbour of both. So a key is
one segment as it is and a nearby codeword of the next: up to 18 keys for each
distinct fingerprint. Rows with a common key are checked exactly and leave a
spanning forest, not all pairs. A key that more than ``BUCKET`` fingerprints
share is left to an exact second way: every fingerprint meets the others at the
words half-way, which are at most 65 to a group and need no check.

Texts count as empty if null; those without words get fingerprint zero and link
like any other. Copies share a fingerprint, so a group of any size is one row in
all steps but the first and the last. A null id never is a component's smallest
one unless it has no other. Repeated rows are kept, with the same component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import columns, map_rows
from codeloom.operators.components import components
from codeloom.session import materialize

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Added to the rows of ``one_of_each`` while it runs.
ROW = "__simhash_row__"
#: Fingerprints that are compared directly with each other under one key.
BUCKET = 512

# The generator polynomial of the binary Golay code, and the segments (offset, bits).
GENERATOR = 0b101011100011
SEGMENTS = [(0, 22), (22, 21), (43, 21)]


def shingles(text: str | None, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in lower case; a shorter text is one run."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -size] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())), "<u8", len(starts)
    )


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit integer."""
    hashes = shingles(text, SHINGLE)
    if not len(hashes):
        return 0
    if len(hashes) == 1:
        return int(hashes.view("<i8")[0])
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", **keep: str) -> DataFrame:
    """The ``keep`` columns under their new names, and ``fp``."""
    rows = columns(docs, **keep, text=text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for *kept, t in it:
            yield *kept, fingerprint(t)

    return map_rows(rows, run, f"{kinds}, fp long")


class Golay:
    """Index of the nearest codeword, for arrays of 23-bit words."""

    def __init__(self):
        self.rests = np.array([_rest(i << 11) for i in range(1 << 12)], np.int64)
        self.errors = np.zeros(1 << 11, np.int64)
        bits = [1 << i for i in range(23)]
        words = [0] + bits
        words += [a ^ b for a in bits for b in bits if a < b]
        words += [a ^ b ^ c for a in bits for b in bits if a < b for c in bits if b < c]
        for w in words:
            self.errors[_rest(w)] = w

    def nearest(self, words: np.ndarray) -> np.ndarray:
        rests = (words & 0x7FF) ^ self.rests[words >> 11]
        return (words ^ self.errors[rests]) >> 11

    def keys(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All keys, and the row that each belongs to."""
        u = fps.astype(np.uint64)
        parts = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
        out, rows = [], []
        for i in range(len(SEGMENTS)):
            j = (i + 1) % len(SEGMENTS)
            flips = np.array([0] + [1 << b for b in range(SEGMENTS[j][1])])
            codes = np.sort(self.nearest(parts[j][:, None] ^ flips), axis=1)
            fresh = np.ones(codes.shape, bool)
            fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
            row, column = np.nonzero(fresh)
            out.append((i << 34) | (parts[i][row] << 12) | codes[row, column])
            rows.append(row)
        return np.concatenate(out), np.concatenate(rows)


def _rest(word: int) -> int:
    for bit in range(word.bit_length() - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) that join all that are reachable."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 20_000):
                part = fps[at : at + 20_000]
                keys, rows = golay.keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    keys = distinct.select("fp").mapInArrow(keyed, "key long, fp long")
    found = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_checked, "a long, b long")
    found = materialize(found, "simhash-links")
    direct = found.where("a != b").distinct()
    rest = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    middle = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    met = rest.select("fp", F.explode(middle).alias("middle")).groupBy("middle").agg(F.collect_set("fp").alias("fps"))
    starred = met.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return direct.unionByName(starred.where("a != b").distinct())


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each key, in sorted rows; a row (x, x) for each x under a key with too many."""
    key, held, over = None, np.empty(0, np.int64), False

    def made(a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (a, b)], names=["a", "b"]
        )

    for batch in batches:
        a, b = [], []
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        if key is not None and len(keys) and keys[0] != key:
            _forest(held, a, b)
            held, over = np.empty(0, np.int64), False
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if lo:
                _forest(held, a, b)
                held, over = np.empty(0, np.int64), False
            key, held = keys[lo], np.concatenate([held, fps[lo:hi]])
            if over or len(held) > BUCKET:
                a.append(held)
                b.append(held)
                held, over = np.empty(0, np.int64), True
        yield made(a, b)
    a, b = [], []
    _forest(held, a, b)
    yield made(a, b)


def _forest(fps: np.ndarray, a: list, b: list) -> None:
    if len(fps) < 2:
        return
    u = np.sort(fps).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= DISTANCE
    low = np.arange(len(u))
    while True:
        lower = np.where(near, low[None, :], len(u)).min(axis=1)
        lower = lower[lower]
        if (lower == low).all():
            break
        low = lower
    moved = low != np.arange(len(u))
    if moved.any():
        a.append(u[low[moved]].view(np.int64))
        b.append(u[moved].view(np.int64))


def grouped(prints: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``prints`` (with doc_id and fp) with ``component_id``, the smallest doc_id, and ``root``, which names the group.

    Without ``found``, links between fingerprints, they are those of near fingerprints.
    """
    per_fp = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = materialize(components(links(per_fp) if found is None else found), "simhash-roots")
    linked = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    named = linked.join(lowest, "root").select("fp", "root", "lowest")
    groups = per_fp.join(named, "fp", "left").select(
        "fp", F.coalesce("lowest", "first").alias("component_id"), F.coalesce("root", "fp").alias("root")
    )
    return prints.join(groups, "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (hex), ``component_id``, ``root``, a row for each row."""
    prints = materialize(fingerprints(docs, text, doc_id=doc_id), "fingerprints")
    return grouped(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root"
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, read from files, with one row of each group: that of the smallest id, null ids last."""
    rows = docs.withColumn(ROW, F.monotonically_increasing_id())
    prints = materialize(fingerprints(rows, text, row=ROW, doc_id=doc_id), "fingerprints")
    return first_of_each(docs, rows, prints)


def first_of_each(docs: DataFrame, rows: DataFrame, prints: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The columns of ``docs`` from ``rows``, for one row of each group of ``prints``."""
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    kept = grouped(prints, found).groupBy("root").agg(F.min_by("row", order).alias(ROW)).select(ROW)
    return rows.join(kept, ROW, "left_semi").select(docs.columns)
