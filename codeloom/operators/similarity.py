"""Similarity of functions by n-grams, trivially shared ones left out."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.bytetokens import TokenHashes, mixed
from codeloom.functions.tokens import ngrams, token_pattern, tokens
from codeloom.session import materialize, partitioned

# Fixed values -----------------------------------------------------------------

MAX_N = 4
TRIVIAL_NGRAMS = 500
#: Tokens whose codes, or different n-grams whose counts, a task holds at a time.
TOKENS = 1 << 20
#: N-grams of the corpus in a bucket, about.
BUCKET = 4_000_000
#: The most frequent tokens, which have a code of two bytes; other tokens are sent as hashes. Places of a table of them.
CODES, SLOTS = 65_535, 1 << 20
#: Characters of the pairs whose n-grams a task counts, about.
PAIRED = 500_000

# ------------------------------------------------------------------------------


def _grams(token_array: Column, max_n: int = MAX_N) -> Column:
    """``array<struct<n, gram>>`` of all n-grams up to ``max_n``.

    Takes a column that holds the tokens: an expression would run once per n-gram.
    """

    def of_length(n: int) -> Column:
        return F.transform(ngrams(token_array, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    return F.concat(*[of_length(n) for n in range(1, max_n + 1)])


def trivial_ngrams(
    texts: DataFrame, column: str, m: int = TRIVIAL_NGRAMS, max_n: int = MAX_N
) -> DataFrame:
    """``(n, gram, count)``: the ``m`` most frequent n-grams of a corpus, of all lengths together.

    Length by length: an n-gram is at most as frequent as the two n-grams in it that
    are one token shorter, and it ranks after shorter ones with its count. So it is
    counted only if both are more frequent than the m-th so far; those are fewer than ``m``.
    """
    found = _trivial(texts, column, m, max_n, _most(texts, column, [], 0, m) if m else [])
    rows = texts.sparkSession.createDataFrame(found, "n int, gram string, count long")
    return rows.orderBy(F.desc("count"), "n", "gram").limit(m)


def _most(texts: DataFrame, column: str, kept: list[list[str]], least: int, m: int) -> list[tuple[str, int]]:
    counts = _counted(texts.select(column), kept).groupBy("gram").agg(F.sum("count").alias("count"))
    best = counts.where(F.col("count") > least).orderBy(F.desc("count"), "gram").limit(m)
    return [tuple(r) for r in best.collect()]


def _frequent(texts: DataFrame, column: str, m: int) -> list[tuple[str, int]]:
    """The ``m`` most frequent tokens, best first, and about as many more as there are codes.

    Tokens lie in the partitions of their counts by hash, so each partition sends its share of the codes, at least ``m``.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max(m, -(-CODES // parts))

    def best(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        order = [("part", "ascending"), ("count", "descending"), ("gram", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=order))
        part = table["part"].to_numpy()
        return table.filter(pa.array(np.arange(len(part)) - np.searchsorted(part, part) < each)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOKENS + each * parts:
                held = best(held)
        if held:
            yield from best(held)

    counts = _counted(texts.select(column), []).groupBy("gram").agg(F.sum("count").alias("count"))
    counts = counts.withColumn("part", F.pmod(F.hash("gram"), F.lit(parts)))
    rows = counts.mapInArrow(run, "gram string, count long, part int").select("gram", "count").collect()
    return sorted(map(tuple, rows), key=lambda r: (-r[1], r[0].encode()))


def _trivial(texts: DataFrame, column: str, m: int, max_n: int, first: list[tuple[str, int]]) -> list[tuple[int, str, int]]:
    """``n, gram, count``, best first; ``first`` has the most frequent tokens."""
    found, least, kept = [], 0, []
    for n in range(1, max_n + 1) if m else []:
        found += [(n, *r) for r in (first[:m] if n == 1 else _most(texts, column, kept, least, m))]
        found = sorted(found, key=lambda r: (-r[2], r[0], r[1].encode()))[:m]
        least = found[-1][2] if len(found) == m else 0
        kept = [*kept, [gram for length, gram, count in found if length == n and count > least]]
        if not kept[-1]:
            break
    return found


def _counted(texts: DataFrame, kept: list[list[str]]) -> DataFrame:
    """``gram, count`` of n-grams that are longer by one token than the last of ``kept``, from its parts alone.

    A row is a part of the texts; a task holds the codes of so many tokens, and counts by code.
    """
    pattern, codes = token_pattern(), {token: i for i, token in enumerate(kept[0])} if kept else {}
    hashes = TokenHashes().of_tokens(list(codes))
    by_hash = np.argsort(hashes)
    # An n-gram's code is that of its first n - 1 tokens, by place in ``kept``, and of its last one.
    width, tables = max(1, len(codes)), []
    for grams in kept[1:]:
        before = {gram: i for i, gram in enumerate(kept[len(tables)])}
        both = [g.rpartition(" ") for g in grams]
        pairs = sorted((before[first] * width + codes[last], g) for (first, _, last), g in zip(both, grams))
        tables.append((np.array([code for code, _ in pairs], np.int64), np.array([grams.index(g) for _, g in pairs], np.int64)))

    def longer(parts: list[np.ndarray]) -> Counter:
        at = ids = np.concatenate(parts)
        for length, (known, place) in enumerate(tables, 2):
            code = at[:-1] * width + ids[length - 1 :]
            where = np.minimum(np.searchsorted(known, code), len(known) - 1)
            at = np.where((at[:-1] >= 0) & (ids[length - 1 :] >= 0) & (known[where] == code), place[where], -1)
        both = (at[:-1] >= 0) & (at[1:] >= 0)
        found, counts = np.unique(at[:-1][both] * width + ids[len(kept) :][both], return_counts=True)
        return Counter({f"{kept[-1][c // width]} {kept[0][c % width]}": n for c, n in zip(found.tolist(), counts.tolist())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen, flat, held = re.compile(pattern).findall, Counter(), [], 0
        hashes_of, known = TokenHashes(), hashes[by_hash]
        for batch in batches:
            if kept:
                for _, found, ends in hashes_of(batch.column(0)):
                    where = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    ids = np.where(known[where] == found, by_hash[where], -1)
                    # No n-gram reaches from a text into the next.
                    flat.append(np.insert(ids, np.repeat(ends, len(kept) + 1), -1))
                    held += len(flat[-1])
                    if held >= TOKENS:
                        seen.update(longer(flat))
                        flat, held = [], 0
            else:
                for text in batch.column(0):
                    seen.update(split(text.as_py() or ""))
                    if len(seen) >= TOKENS:
                        yield batch_of(seen)
                        seen = Counter()
            if len(seen) >= TOKENS:
                yield batch_of(seen)
                seen = Counter()
        if flat:
            seen.update(longer(flat))
        yield batch_of(seen)

    def batch_of(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["gram", "count"])

    return texts.mapInArrow(run, "gram string, count long")


def _bleu(matched: list[Column], total: list[Column], penalty: Column) -> Column:
    """Geometric mean of the precisions; zero as soon as one of them is."""
    log_sum = F.lit(0.0)
    for hit, all_ in zip(matched, total):
        log_sum = log_sum + F.log(hit / F.nullif(all_, F.lit(0)))
    zero = F.least(*matched) == 0
    return F.when(zero, F.lit(0.0)).otherwise(penalty * F.exp(log_sum / len(matched)))


def pair_similarity(pairs: DataFrame, trivial: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """``pairs(id, candidate, reference)`` to precisions and a score per pair.

    BLEU on the n-grams that are not trivially shared: a candidate's n-gram counts
    at most as often as the reference has it. The trivial n-grams have a fixed
    number, so the plan broadcasts them. The texts are partitioned by pair before
    they explode into n-grams, and every count keeps that partitioning: n-grams
    are never shuffled. Partitions grow in number with the texts, so that what a
    task counts does not grow. Only the given pairs are compared.
    """
    characters = pairs.agg(F.sum(F.coalesce(F.length("candidate"), F.lit(0)) + F.coalesce(F.length("reference"), F.lit(0))))
    least = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, (characters.first()[0] or 0) // PAIRED)
    cand, ref = (tokens(F.coalesce(F.col(c), F.lit(""))) for c in ("candidate", "reference"))

    def side(grams: Column, name: str) -> Column:
        return F.transform(
            grams, lambda g: F.struct(g["n"].alias("n"), g["gram"].alias("gram"), F.lit(name).alias("side"))
        )

    # The last entry keeps pairs that have no n-gram left.
    keep = F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("gram"), F.lit("").alias("side")))
    rows = pairs.repartition(parts, "id").select("id", cand.alias("c"), ref.alias("r")).select(
        "id",
        F.size("c").alias("candidate_tokens"),
        F.size("r").alias("reference_tokens"),
        F.inline(F.concat(side(_grams(F.col("c"), max_n), "c"), side(_grams(F.col("r"), max_n), "r"), keep)),
    )
    key = ["id", "candidate_tokens", "reference_tokens"]
    counts = (
        rows.join(trivial.select("n", "gram"), ["n", "gram"], "left_anti")
        .groupBy(*key, "n", "gram")
        .agg(F.count_if(F.col("side") == "c").alias("c"), F.count_if(F.col("side") == "r").alias("r"))
    )
    sums = []
    for n in range(1, max_n + 1):
        of_n = F.col("n") == n
        sums += [
            F.coalesce(F.sum(F.when(of_n, F.least("c", "r"))), F.lit(0)).alias(f"matched_{n}"),
            F.coalesce(F.sum(F.when(of_n, F.col("c"))), F.lit(0)).alias(f"total_{n}"),
        ]
    longer = F.col("candidate_tokens") >= F.col("reference_tokens")
    penalty = F.when(longer, F.lit(1.0)).otherwise(
        F.exp(1 - F.col("reference_tokens") / F.nullif(F.col("candidate_tokens"), F.lit(0)))
    )
    matched = [F.col(f"matched_{n}") for n in range(1, max_n + 1)]
    total = [F.col(f"total_{n}") for n in range(1, max_n + 1)]
    return counts.groupBy(*key).agg(*sums).select("*", _bleu(matched, total, penalty).alias("score"))


#: An n-gram by 128 bits, so that strings are neither aggregated nor shuffled.
GRAM = ["h0", "h1"]


def _gram(pos: Column, n: Column, max_n: int) -> Column:
    """The n-gram at a position of the token column ``t``."""

    def of(length: int) -> Column:
        return F.concat_ws(" ", *[F.get("t", pos + j) for j in range(length)])

    picked = F.when(n == 1, of(1))
    for length in range(2, max_n + 1):
        picked = picked.when(n == length, of(length))
    return picked


def gram_counts(texts: DataFrame, key: str, column: str, max_n: int = MAX_N) -> DataFrame:
    """``(key, h0, h1, n, pos, c)``: how often each text has each n-gram, and where; written once, for all that reads it.

    A text's n-grams are numbered and picked by number, so a row explodes once
    and stays in generated code. Texts are partitioned before that: counting
    within a text needs no shuffle. Keys must be unique.
    """
    pos, n = F.expr(f"i div {max_n}").cast("int"), F.expr(f"i % {max_n} + 1").cast("int")
    counts = (
        partitioned(texts.select(F.col(key).alias("key"), column), "key")
        .select("key", tokens(F.col(column)).alias("t"))
        .where(F.size("t") > 0)
        .select("key", "t", F.explode(F.sequence(F.lit(0), F.size("t") * max_n - 1)).alias("i"))
        .select("key", "t", pos.alias("pos"), n.alias("n"))
        .where(F.col("pos") + F.col("n") <= F.size("t"))
        .select("key", "n", "pos", _gram(F.col("pos"), F.col("n"), max_n).alias("gram"))
        .select("key", "n", "pos", F.xxhash64("gram").alias("h0"), F.xxhash64(F.lit(1), "gram").alias("h1"))
        .groupBy("key", *GRAM)
        .agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"), F.min("pos").alias("pos"))
    )
    return materialize(counts, "gram-counts")


class _Keys:
    """A number for each token: rarer tokens have higher ones, those of the most frequent tokens are below ``CODES``."""

    def __init__(self, frequent: list[str]):
        hashes = TokenHashes().of_tokens(frequent[:CODES])
        # Of several tokens at a place, the most frequent one has a code.
        slots, first = np.unique((hashes >> np.uint64(44)).astype(np.int64), return_index=True)
        self.hashes, self.table = hashes, np.full(SLOTS, -1, np.int32)
        self.table[slots] = first

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return hashes | np.uint64(1 << 63)
        code = self.table[(hashes >> np.uint64(44)).astype(np.int64)]
        has = (code >= 0) & (self.hashes[code] == hashes)
        return np.where(has, code.astype(np.uint64), hashes | np.uint64(1 << 63))


def _longer(x: np.ndarray, y: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of n-grams with one more token."""
    return mixed(x * np.uint64(0x9E3779B97F4A7C15) + keys), mixed(y * np.uint64(0xD6E8FEB86659FD93) + keys)


def _grouped(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by n-gram, and for each place in it if a group begins; within a group, rows stay as they are."""
    low = np.uint64((1 << max(1, (len(x) - 1).bit_length())) - 1)
    both = (x & ~low) | np.arange(len(x), dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    x_, y_ = x[order], y[order]
    differ = (x_[1:] != x_[:-1]) | (y_[1:] != y_[:-1])
    if (differ & ((both[1:] & ~low) == (both[:-1] & ~low))).any():
        order = np.lexsort((y, x))
        x_, y_ = x[order], y[order]
        differ = (x_[1:] != x_[:-1]) | (y_[1:] != y_[:-1])
    return order, np.concatenate([[True], differ])


def _reach(keys: np.ndarray, owner: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """How far to each side of a token the n-grams go of which it is the rarest token, the first of equal ones."""
    sides = []
    for left in (True, False):
        held, inside = np.zeros(len(keys), np.int16), np.ones(len(keys), bool)
        for d in range(1, min(max_n, len(keys))):
            same = owner[d:] == owner[:-d]
            if left:
                inside[d:] &= same & (keys[:-d] < keys[d:])
                inside[:d] = False
            else:
                inside[:-d] &= same & (keys[d:] <= keys[:-d])
                inside[-d:] = False
            held += inside
        sides.append(held)
    return sides[0], sides[1]


def _planes(a: np.ndarray, width: int) -> bytes:
    """The lowest bytes of numbers, by place of the byte, so that leading zeros of all stand together."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(raw: np.ndarray, width: int) -> np.ndarray:
    cells = np.zeros((len(raw) // width, 8), np.uint8)
    cells[:, :width] = raw.reshape(width, -1).T
    return cells.view("<u8").ravel()


_PIECES = "bucket int, bundle long, sizes array<long>, cells binary"


def _bundles(texts: DataFrame, keys: Broadcast, lone: np.ndarray, buckets: int, parts: int, max_n: int) -> DataFrame:
    """``texts(name, text)`` to pieces: of each bundle of texts and each bucket, tokens with what is around them.

    Every n-gram lies once around its rarest token, and goes to that token's bucket;
    tokens of ``lone`` go nowhere if they are the rarest of no longer n-gram. Names of a bundle's texts
    are a piece above the buckets. Bundles are numbered by partition, in the order of its texts' names.
    """

    def bundle(number: int, names: list[int], hashes: list[np.ndarray]) -> Iterator[tuple]:
        yield buckets + number % parts, number, [len(names)], np.array(names, np.int64).tobytes()
        owner, key = np.repeat(np.arange(len(names), dtype=np.int32), [len(h) for h in hashes]), keys.value(np.concatenate(hashes))
        left, right = _reach(key, owner, max_n)
        at = np.flatnonzero((left + right > 0) | ~np.isin(key, lone))
        of = ((mixed(key[at]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32 if buckets >> 16 else np.uint16)
        order = np.argsort(of, kind="stable")
        at, of = at[order], of[order]
        left, owner, size = left[at], owner[at], (left + right + 1)[at]
        ends = np.cumsum(size, dtype=np.int64)
        tokens_ = key[np.repeat((at - left - ends + size).astype(np.int32), size) + np.arange(size.sum(), dtype=np.int32)]
        code = np.minimum(tokens_, np.uint64(CODES))
        rare, shape = code == CODES, left * max_n + size - 1 - left
        edges = np.searchsorted(of, np.arange(buckets + 1))
        ends, rares = np.concatenate([[0], ends]), np.concatenate([[0], np.cumsum(rare)])
        tokens_ = tokens_[rare]
        for i in np.flatnonzero(np.diff(edges)):
            lo, hi = edges[i], edges[i + 1]
            a, b = ends[lo], ends[hi]
            raw = _planes(np.diff(owner[lo:hi], prepend=0), 4) + _planes(shape[lo:hi], 1) + _planes(code[a:b], 2) + tokens_[rares[a] : rares[b]].tobytes()
            yield int(i), number, [int(hi - lo), int(b - a)], zstandard.compress(raw, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of, names, parts_, size = TokenHashes(), [], [], 0
        number = TaskContext.get().partitionId() << 32

        def packed() -> pa.RecordBatch:
            kinds = pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()
            rows = zip(*bundle(number, names, parts_))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["bucket", "bundle", "sizes", "cells"])

        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, hashes, ends in hashes_of(batch.column(1)):
                parts_ += np.split(hashes, ends[:-1])
                names += own[first : first + len(ends)]
                size += len(hashes)
                if size >= TOKENS:
                    yield packed()
                    names, parts_, size, number = [], [], 0, number + 1
        if names:
            yield packed()

    return texts.sortWithinPartitions("name", "text").mapInArrow(run, _PIECES)


def _scores(pieces: DataFrame, trivial: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], buckets: int, max_n: int) -> DataFrame:
    """Sums of a bucket for the texts of each bundle, as pieces; those of names as they are. A partition has its pieces sorted by bucket.

    ``trivial`` has hashes of n-grams, by the number of tokens before and after their rarest one.
    """

    def scored(held: list[tuple]) -> Iterator[tuple]:
        columns, present = [], []
        for number, (n, m), raw in held:
            cells = np.frombuffer(zstandard.decompress(raw), np.uint8)
            owner = np.cumsum(_numbers(cells[: 4 * n], 4)).astype(np.int64)
            shape, keys = cells[4 * n : 5 * n].astype(np.int64), _numbers(cells[5 * n : 5 * n + 2 * m], 2)
            keys[keys == CODES] = np.frombuffer(cells[5 * n + 2 * m :].tobytes(), np.uint64)
            new = np.diff(owner, prepend=-1) > 0
            columns.append((np.cumsum(new) - 1, shape, keys))
            present.append((number, owner[new]))
        starts = np.cumsum([0, *[len(p) for _, p in present]])
        text = np.concatenate([c[0] + s for c, s in zip(columns, starts)])
        shape, keys = (np.concatenate([c[i] for c in columns]) for i in (1, 2))
        left, right = shape // max_n, shape % max_n
        size = left + right + 1
        centre = np.cumsum(size) - size + left
        sums = np.zeros((2, starts[-1]), np.int64)
        for i in range(max_n):
            some = np.flatnonzero(left >= i)
            if not len(some):
                break
            at = centre[some] - i
            x = y = np.zeros(len(some), np.uint64)
            for k in range(i):
                x, y = _longer(x, y, keys[at + k])
            for j in range(max_n - i):
                if j:
                    more = right[some] >= j
                    some, at, x, y = some[more], at[more], x[more], y[more]
                if not len(some):
                    break
                x, y = _longer(x, y, keys[at + i + j])
                sums += counted(x, y, text[some], trivial.get((i, j)), starts[-1])
        for (number, own), lo, hi in zip(present, starts, starts[1:]):
            raw = _planes(np.diff(own, prepend=0), 4) + _planes(sums[0, lo:hi], 8) + _planes(sums[1, lo:hi], 8)
            yield -1, number, [len(own)], zstandard.compress(raw, 1)

    def counted(x: np.ndarray, y: np.ndarray, text: np.ndarray, common: tuple | None, texts_: int) -> np.ndarray:
        """Matched and all n-grams of each text, for n-grams of one shape; ``text`` ascends."""
        order, new = _grouped(x, y)
        text = text[order]
        entry = np.flatnonzero(new | np.concatenate([[True], text[1:] != text[:-1]]))
        count, text, new = np.diff(entry, append=len(order)), text[entry], new[entry]
        if common is not None:
            x, y = x[order][entry], y[order][entry]
            at = np.flatnonzero(np.isin(x, common[0]))
            pairs = set(zip(*[c.tolist() for c in common]))
            drop = at[[p in pairs for p in zip(x[at].tolist(), y[at].tolist())]] if len(at) else at
            keep = np.ones(len(count), bool)
            keep[drop] = False
            count, text, new = count[keep], text[keep], new[keep]
        total = np.bincount(text, count, texts_).astype(np.int64)
        several = ~new | np.concatenate([~new[1:], [False]])
        count, text, lead = count[several], text[several], np.flatnonzero(new[several])
        if not len(lead):
            return np.stack([np.zeros(texts_, np.int64), total])
        each = np.diff(lead, append=len(count))
        most = np.repeat(np.maximum.reduceat(count, lead), each)
        highest = count == most
        alone = highest & (np.repeat(np.add.reduceat(highest.astype(np.int64), lead), each) == 1)
        # The only text with the highest count has the next one as others.
        others = np.where(alone, np.repeat(np.maximum.reduceat(np.where(highest, 0, count), lead), each), most)
        return np.stack([np.bincount(text, np.minimum(count, others), texts_).astype(np.int64), total])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(cells: list[tuple]) -> pa.RecordBatch:
            kinds = pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), kinds)], names=["bucket", "bundle", "sizes", "cells"])

        held, now = [], None
        for batch in batches:
            for bucket, *piece in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket >= buckets:
                    yield rows([(bucket, *piece)])
                    continue
                if held and bucket != now:
                    yield rows(list(scored(held)))
                    held = []
                now = bucket
                held.append(piece)
        if held:
            yield rows(list(scored(held)))

    return pieces.mapInArrow(run, _PIECES)


def _named(sums: DataFrame) -> DataFrame:
    """``name, matched, total`` for each text, from pieces that are sorted by bundle, names first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(names: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (names, *held)], names=["name", "matched", "total"])

        names = held = None
        for batch in batches:
            for bucket, (n,), raw in zip(*[batch.column(c).to_pylist() for c in ("bucket", "sizes", "cells")]):
                if bucket >= 0:
                    if names is not None:
                        yield row(names, held)
                    names, held = np.frombuffer(raw, np.int64), np.zeros((2, n), np.int64)
                    continue
                cells = np.frombuffer(zstandard.decompress(raw), np.uint8)
                own = np.cumsum(_numbers(cells[: 4 * n], 4)).astype(np.int64)
                held[0, own] += _numbers(cells[4 * n : 12 * n], 8).view(np.int64)
                held[1, own] += _numbers(cells[12 * n :], 8).view(np.int64)
        if names is not None:
            yield row(names, held)

    return sums.mapInArrow(run, "name long, matched long, total long")


def corpus_similarity(
    texts: DataFrame, key: str, column: str, m: int = TRIVIAL_NGRAMS, max_n: int = MAX_N
) -> DataFrame:
    """How much of each text's n-grams the rest of the corpus has, the ``m`` most frequent left out.

    The same clipped counts with all other texts as references: an n-gram counts
    at most as often as some other text has it. Instead of comparing pairs, each
    n-gram keeps its two highest counts in a text, so the work is linear in the corpus. A
    key names one text, and 64 bits of it do in between.

    An n-gram is dealt to a bucket by its rarest token. What is sent of a text is
    each token with the tokens around it that are in n-grams of which it is the
    rarest, some three tokens a token, in bundles of bytes that are shuffled once and
    written nowhere. The number of buckets grows with the corpus, so that a task
    holds a bounded part of it; its sums go back to the bundles as bytes.
    """
    first = _frequent(texts, column, m)
    keys, trivial, lone = _Keys([token for token, _ in first]), {}, []
    for n, gram, _ in _trivial(texts, column, m, max_n, first):
        own = keys(TokenHashes().of_tokens(gram.split(" ")))
        centre = int(own.argmax())
        x = y = np.zeros(1, np.uint64)
        for k in range(n):
            x, y = _longer(x, y, own[k : k + 1])
        trivial.setdefault((centre, n - 1 - centre), []).append((x[0], y[0]))
        lone += own.tolist() if n == 1 else []
    trivial = {k: tuple(np.array(c, np.uint64) for c in zip(*v)) for k, v in trivial.items()}
    characters = texts.agg(F.sum(F.length(column))).first()[0] or 0
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, characters * max_n // 4 // BUCKET)
    name, shared = F.xxhash64(key), texts.sparkSession.sparkContext.broadcast(keys)
    held = texts.select(name.alias("name"), F.col(column).alias("text"))
    pieces = _bundles(held, shared, np.array(lone, np.uint64), buckets, parts, max_n)
    sums = _scores(pieces.repartition(parts, "bucket").sortWithinPartitions("bucket"), trivial, buckets, max_n)
    scores = _named(sums.repartition(parts, "bundle").sortWithinPartitions("bundle", F.desc("bucket")))
    scores = scores.groupBy("name").agg(F.sum("matched").alias("matched"), F.sum("total").alias("total"))
    matched, total = (F.coalesce(c, F.lit(0)) for c in ("matched", "total"))
    return (
        texts.select(F.col(key).alias("key"), name.alias("name"))
        .join(scores, "name", "left")
        .select(
            F.col("key").alias(key),
            matched.alias("matched"),
            total.alias("total"),
            F.coalesce(matched / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("shared"),
        )
    )
