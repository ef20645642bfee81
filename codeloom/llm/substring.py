"""Removal of word windows that occur before, by super-k-mers.

A window is ``WINDOW`` consecutive words. Its minimiser is the lowest hash among
its runs of ``MINIMISER`` words. Consecutive windows with the same minimiser, at
the same place, travel as one packed string to the bucket of that hash, so equal
windows meet, and a word is sent about three times instead of twenty. In the
bucket windows are sorted by hash and place; equal ones are compared byte by
byte. All but the first of them in the order of (doc_id, row, start) are
reported, merged to ranges, and the words they cover are removed.

A task sends a packed string once: a later copy of it can only hold windows
that start earlier elsewhere, and is reported at once. So a passage that a third
of all rows share is one string a task in its bucket.

Null and shorter texts have no windows. Null ids come after all others, repeated
rows are ordered as they are read, so the input must be read from files.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_rows

WINDOW, MINIMISER = 20, 4
#: Buckets for each shuffle partition; one bucket is held in memory.
BUCKETS_EACH = 4
#: Bytes of packed strings that a task gathers before it sends them, and strings that it remembers.
GATHERED, REMEMBERED = 1 << 24, 400_000
LAST_ID = np.iinfo(np.int64).max
SCHEMA = "bucket int, blob binary, row long, start int, end int"

_U = np.uint64
_MIX, _BASE = _U(0x9E3779B97F4A7C15), 0x5851F42D4C957F2D
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def super_kmers(hashes: np.ndarray, window: int = WINDOW, k: int = MINIMISER) -> tuple[np.ndarray, ...]:
    """First window, last window and minimiser of each run of windows that share a minimiser's place."""
    n = len(hashes) - window + 1
    runs = hashes[: len(hashes) - k + 1].copy()
    for i in range(1, k):
        runs = runs * _MIX + hashes[i : len(hashes) - k + 1 + i]
    runs ^= runs >> _U(29)
    runs *= _MIX
    runs ^= runs >> _U(32)
    place = np.lib.stride_tricks.sliding_window_view(runs, window - k + 1).argmin(axis=1) + np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return first, last, runs[place[first]]


def ranges(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``row, start, end``: ranges of words to remove, of rows (row, doc_id, text); they may touch and overlap."""
    if buckets is None:
        buckets = BUCKETS_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(it: Iterator[tuple]) -> Iterator[tuple]:
        hashes, seen, held, size = _Hashes(), {}, defaultdict(list), 0
        local: list[tuple[int, int, int]] = []
        for row, d, text in it:
            words = (text or "").encode("utf-8", "replace").split()
            if len(words) < WINDOW:
                continue
            if len(hashes) > REMEMBERED:
                hashes.clear()
            if len(seen) > REMEMBERED:
                seen.clear()
            d = LAST_ID if d is None else d
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
            first, last, low = super_kmers(h)
            begin = np.where(first > 0, ends[first - 1] + 1, 0)
            parts = zip(first.tolist(), last.tolist(), (low % _U(buckets)).tolist(), begin.tolist(), ends[last + WINDOW - 1].tolist())
            for s, t, bucket, a, b in parts:
                string = joined[a:b]
                name, place = xxhash.xxh3_128_digest(string), (d, row, s)
                if name in seen and seen[name] < place:
                    local.append((row, s, t + WINDOW))
                else:
                    seen[name] = place
                    held[bucket].append((place, string))
                    size += b - a
            if size >= GATHERED:
                yield from _sent(held)
                held, size = defaultdict(list), 0
            if len(local) > 10_000:
                for x in _merged(local):
                    yield x[0] % buckets, None, *x
                local = []
        yield from _sent(held)
        for x in _merged(local):
            yield x[0] % buckets, None, *x

    def counted(it: Iterator[tuple]) -> Iterator[tuple]:
        bucket, blobs = None, []
        for b, blob, *place in it:
            if blob is None:
                yield tuple(place)
                continue
            if b != bucket:
                yield from _repeats(blobs)
                bucket, blobs = b, []
            blobs.append(blob)
        yield from _repeats(blobs)

    sent = map_rows(docs.select("row", "doc_id", "text"), packed, SCHEMA)
    together = sent.repartition("bucket").sortWithinPartitions("bucket")
    return map_rows(together, counted, "row long, start int, end int")


def _sent(held: dict[int, list]) -> Iterator[tuple]:
    for bucket, strings in held.items():
        places = np.array([p for p, _ in strings], np.int64)
        raw = len(strings).to_bytes(8, "little") + places.tobytes() + b"\n".join(s for _, s in strings)
        yield bucket, zstandard.compress(raw, 1), None, None, None


def _merged(found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    row, start, end = None, 0, 0
    for r, s, e in sorted(found):
        if r == row and s <= end:
            end = max(end, e)
            continue
        if row is not None:
            yield row, start, end
        row, start, end = r, s, e
    if row is not None:
        yield row, start, end


def _repeats(blobs: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """Ranges of the windows of one bucket that are not the first of their kind."""
    if not blobs:
        return
    texts, columns, at = [], [], 0
    for blob in blobs:
        raw = zstandard.decompress(blob)
        n = int.from_bytes(raw[:8], "little")
        places = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3)
        text = raw[8 + 24 * n :]
        columns.append(_windows(text, places, at))
        texts.append(text)
        at += len(text)
    text = b"".join(texts)
    del texts
    h, doc, row, start, begin, end = (np.concatenate(c) for c in zip(*columns))
    del columns
    order = np.lexsort((start, row, doc, h))
    same = h[order][1:] == h[order][:-1]
    lead = np.flatnonzero(np.concatenate([[True], ~same]))
    sizes = np.diff(np.concatenate([lead, [len(order)]]))
    found = []
    for i, n in zip(lead[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        own = order[i : i + n]
        spans = list(zip(begin[own].tolist(), end[own].tolist()))
        head = text[spans[0][0] : spans[0][1]]
        kinds = {head}
        for j, (a, b) in zip(own[1:].tolist(), spans[1:]):
            string = text[a:b]
            if string == head or string in kinds:
                found.append(j)
            else:
                kinds.add(string)
    if found:
        s = start[found]
        yield from _merged(list(zip(row[found].tolist(), s.tolist(), (s + WINDOW).tolist())))


def _windows(text: bytes, places: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
    """Hash, doc, row, start, and first and last byte of each window of the strings."""
    a = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero((a == 32) | (a == 10))
    begins, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(a)]])
    line = np.concatenate([[0], np.cumsum(a[gaps] == 10)])
    first = np.flatnonzero(line[: len(line) - WINDOW + 1] == line[WINDOW - 1 :])
    head = np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1])
    powers = np.full(len(a) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[a] * powers[:-1])])
    b, e, of = begins[first], ends[first + WINDOW - 1], line[first]
    # Divided by the power of the place, so that equal windows have equal hashes wherever they are.
    inverse = np.full(len(a) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    h = (sums[e] - sums[b]) * np.cumprod(inverse)[b]
    return h, places[of, 0], places[of, 1], places[of, 2] + first - head[of], b + at, e + at


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """``rest`` (all other columns), ``doc_id, text, n_words, n_removed, kept``: the kept words joined by one space."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)] or [F.lit(0).alias("none")]
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*rest).alias("rest"),
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
    )
    found = ranges(rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text"), buckets)
    cuts = found.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    joined = rows.join(cuts, "row", "left").select("rest", "doc_id", "text", "cuts")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema[1:-1])

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for rest, d, text, cuts in it:
            words = (text or "").encode("utf-8", "replace").split()
            keep = np.ones(len(words), bool)
            for c in cuts or []:
                keep[c["start"] : c["end"]] = False
            kept = [words[i] for i in np.flatnonzero(keep).tolist()] if cuts else words
            yield rest, d, text, len(words), len(words) - len(kept), b" ".join(kept).decode()

    kind = joined.schema["rest"].dataType.simpleString()
    return map_rows(joined, run, f"rest {kind}, {schema}, n_words long, n_removed long, kept string")


def rewritten(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated words in ``text``; texts that have none stay as they are."""
    new = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    named = {doc_id: F.col("doc_id"), text: new}
    out = [named[c].alias(c) if c in named else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return remove_repeats(docs, doc_id, text).select(*out)
