"""Classes of similar texts: sets of n-grams with a Jaccard similarity above a threshold.

Candidates are sets under a common key. Under a key nothing is paired at first: a
hub, the set with the commonest n-grams there, is compared with the others, so a
group of near copies costs a comparison for each. What is left are pairs of sets
in different classes. Those can only be similar if they share some of their rarest
n-grams, as many as the threshold leaves room for (a prefix in the order of
rarity), and if enough n-grams follow the shared ones in both for their sizes.
A list of sets under an n-gram goes on only if it has sets of different classes,
and a set in it only if its place and size let it have a partner there. Frequent
n-grams are in no prefix but those of sets that have no others.

Sets are not written: they are made from the texts by each pass that needs them.
Prefixes are shuffled once, as bundles of bytes, and only lists that hold several
sets become rows; of sets as a whole only those of pairs that their heads leave.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.bytetokens import TokenHashes, mixed
from codeloom.operators.components import components
from codeloom.session import materialize

#: Tokens of an n-gram, and the least similarity of a link.
GRAM, SIMILAR = 4, 0.8
#: Counts of n-grams are kept by hash in so many places, which bounds what is sent to tasks.
PLACES = 1 << 20
#: Places that are added up together.
RANGE = 1 << 14
#: Sets that one task compares with a hub in a row.
MEMBERS = 512
#: N-grams of prefixes in a bundle, and in a bucket, about.
BUNDLE, BUCKET = 1 << 20, 4_000_000
#: Bits of an n-gram that name its list, and bits of a filter for each set.
LIST_BITS, FILTER_BITS = 48, 16
#: Slack of products with a threshold, which is no exact binary number.
SLACK = 1e-9


class Made:
    """Rows that tasks make from those of a table, and make something of in the same process."""

    def __init__(self, table: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        self.table, self.run, self.sparkSession = table, run, table.sparkSession

    def select(self, *names: str) -> Made:
        made = self.run
        return Made(self.table, lambda batches: (b.select(list(names)) for b in made(batches)))

    def mapInArrow(self, run: Callable, schema: str) -> DataFrame:
        made = self.run
        return self.table.mapInArrow(lambda batches: run(made(batches)), schema)


# Candidates -------------------------------------------------------------------


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` tokens, from those of the tokens."""
    grams = np.zeros(len(hashes) + 1, np.uint64)
    for i in range(n):
        grams = mixed(grams[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[i:])
    return mixed(grams ^ np.uint64(n))


def gram_sets(texts: DataFrame, key: str, column: str, n: int = GRAM) -> DataFrame:
    """``id, fp, grams``: distinct hashes of a text's n-grams, sorted, in bytes; shorter texts are one, texts without tokens have none."""
    kind = texts.select(key).schema[0].dataType.simpleString()
    return made_sets(texts, key, column, n).mapInArrow(lambda batches: batches, f"id {kind}, fp long, grams binary")


def made_sets(texts: DataFrame, key: str, column: str, n: int = GRAM, among: tuple[Broadcast, int] | None = None) -> Made:
    """What ``gram_sets`` gives, for use in the tasks that make it.

    With ``among``, only of texts whose keys a filter has (see ``_filter``).
    """
    rows = texts.select(F.col(key).alias("id"), F.col(column).alias("text"), F.xxhash64(key).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = TokenHashes()
        for batch in batches:
            if among is not None:
                batch = batch.filter(_passes(batch.column(2), among))
            for first, hashes, ends in hashes_of(batch.column(1)):
                fps, cells = [], []
                whole, start = _grams(hashes, n) if len(hashes) >= n else hashes, 0
                for end in ends.tolist():
                    some = min(n, end - start)
                    grams = np.unique(whole[start : end - n + 1]) if some == n else _grams(hashes[start:end], some) if some else hashes[:0]
                    cells.append(grams.astype("<u8").tobytes())
                    fps.append(xxhash.xxh64_intdigest(cells[-1]))
                    start = end
                names = batch.column(0).slice(first, len(fps))
                arrays = [names, pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(cells, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "fp", "grams"])

    return Made(rows, run)


def packed(sets: DataFrame | Made) -> DataFrame | Made:
    """``fp, grams``: sorted unsigned integers, in bytes."""
    return sets.select("fp", "grams")


def _filter(names: DataFrame) -> tuple[Broadcast, int]:
    """Bits at the places of a column of longs, and their number."""
    places = names.toArrow().column(0).to_numpy().view(np.uint64)
    size = max(1 << 10, 1 << (FILTER_BITS * len(places)).bit_length())
    bits = np.zeros(size, bool)
    bits[(places % np.uint64(size)).astype(np.int64)] = True
    return names.sparkSession.sparkContext.broadcast(np.packbits(bits)), size


def _passes(column: pa.Array, held: tuple[Broadcast, int]) -> pa.Array:
    at = (column.to_numpy().view(np.uint64) % np.uint64(held[1])).astype(np.int64)
    return pa.array((held[0].value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))


def only(sets: DataFrame | Made) -> Callable[[DataFrame], DataFrame]:
    """For a table of ``fp``: those of ``sets``, each once; the rest, but for a few, is left out where it is made."""

    def of(fps: DataFrame) -> DataFrame:
        fps = materialize(fps.distinct(), "similar-fps")
        held = _filter(fps)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(_passes(batch.column(0), held))

        few = sets.select("fp", "grams").mapInArrow(run, "fp long, grams binary")
        return few.dropDuplicates(["fp"]).join(fps, "fp", "left_semi")

    return of


def _planes(a: np.ndarray, width: int) -> bytes:
    """The lowest bytes of numbers, by place of the byte."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(raw: np.ndarray, width: int) -> np.ndarray:
    cells = np.zeros((len(raw) // width, 8), np.uint8)
    cells[:, :width] = raw.reshape(width, -1).T
    return cells.view("<u8").ravel()


def _added(grams: list[bytes], counts: np.ndarray) -> None:
    for raw in grams:
        # A set's places may repeat, as places are fewer than hashes.
        np.add.at(counts, (np.frombuffer(raw, "<u8") % np.uint64(PLACES)).astype(np.int64), 1)


def _ranges(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    at = [i for i in range(0, PLACES, RANGE) if counts[i : i + RANGE].any()]
    return at, [zstandard.compress(_planes(counts[i : i + RANGE], 8), 1) for i in at]


def _summed(ranges: DataFrame) -> np.ndarray:
    """Counts by place, from those of tasks (at, counts)."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(PLACES, np.int64)
        for batch in batches:
            for at, raw in zip(*[c.to_pylist() for c in batch.columns]):
                sums[at : at + RANGE] += _numbers(np.frombuffer(zstandard.decompress(raw), np.uint8), 8).view(np.int64)
        at, cells = _ranges(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(cells, pa.binary())], names=["at", "counts"])

    counts = np.zeros(PLACES, np.int64)
    for at, raw in zip(*[c.to_pylist() for c in ranges.repartition("at").mapInArrow(added, "at long, counts binary").toArrow().columns]):
        counts[at : at + RANGE] = _numbers(np.frombuffer(zstandard.decompress(raw), np.uint8), 8)
    return counts


def rarity(sets: DataFrame | Made) -> np.ndarray:
    """How many of the packed sets have an n-gram, by the place of its hash; others at that place are counted in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PLACES, np.int64)
        for batch in batches:
            _added(batch.column(0).to_pylist(), counts)
        at, cells = _ranges(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(cells, pa.binary())], names=["at", "counts"])

    return _summed(sets.select("grams").mapInArrow(run, "at long, counts binary"))


def names_and_rarity(sets: Made, kind: str) -> tuple[DataFrame, np.ndarray]:
    """``id, fp`` of all sets, written, and ``rarity``, in one pass; ``kind`` is that of ``id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, empty = np.zeros(PLACES, np.int64), None
        for batch in batches:
            empty, n = batch.column(0)[:0], batch.num_rows
            _added(batch.column(2).to_pylist(), counts)
            arrays = [*batch.columns[:2], pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "fp", "at", "counts"])
        at, cells = _ranges(counts)
        if at:
            ids = pa.nulls(len(at), empty.type)
            arrays = [ids, pa.nulls(len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "fp", "at", "counts"])

    both = materialize(sets.select("id", "fp", "grams").mapInArrow(run, f"id {kind}, fp long, at long, counts binary"), "similar-texts")
    return both.where("at IS NULL").select("id", "fp"), _summed(both.where("at IS NOT NULL").select("at", "counts"))


def rare_first(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return grams[np.lexsort((grams, counts[(grams % np.uint64(PLACES)).astype(np.int64)]))]


def met_at_least(threshold: float) -> int:
    """N-grams that the prefixes of two similar sets have in common: four if all similar sets, unless they are equal, have that many."""
    return max(1, min(4, math.ceil(threshold / (1 - threshold) - SLACK))) if threshold < 1 else 4


def prefix(grams: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest n-grams of a set: of those that a similar set has in common with it, ``met_at_least`` are among these."""
    n = len(grams)
    return rare_first(grams, counts)[: n - math.ceil(threshold * n - SLACK) + met_at_least(threshold)] if n else grams


def postings(sets: DataFrame | Made, counts: Broadcast, threshold: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Written tables ``gram, fp, n, after`` and ``fp, grams, common``, from one pass over the sets.

    The first has lists of the sets with an n-gram in their prefix, and how many
    n-grams they can have in common if it is among the first ``met_at_least``: only lists of several sets, and in them sets that a
    size in their list lets have a partner. Prefixes are dealt to buckets by n-gram,
    in bundles; a set that comes more than once is in its lists once.

    The second has heads: a set's size and 32 bits of each n-gram of its prefix,
    sorted, in bytes; a tenth of the set. ``common`` is how many sets have a set's
    n-grams, all together; high for what near copies are copies of.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, met = max(parts, int(counts.value.sum() * (1 - threshold)) // BUCKET), met_at_least(threshold)
    kinds = "bucket int, fps array<long>, sizes array<long>, cells binary"

    def bundle(fps: list[int], sizes: list[int], rare: list[np.ndarray], common: list[int]) -> Iterator[tuple]:
        owner = np.repeat(np.arange(len(rare), dtype=np.int32), [len(r) for r in rare])
        after = np.concatenate([n + met - 1 - np.arange(len(r), dtype=np.int32) for n, r in zip(sizes, rare)])
        key = np.concatenate(rare) >> np.uint64(64 - LIST_BITS)
        order = np.argsort(key)
        key, owner, after = key[order], owner[order], after[order]
        edges = np.searchsorted((key >> np.uint64(LIST_BITS - 32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
        for i in np.flatnonzero(np.diff(edges)):
            lo, hi = edges[i], edges[i + 1]
            here, local = np.unique(owner[lo:hi], return_inverse=True)
            raw = _planes(np.diff(key[lo:hi], prepend=np.uint64(0)), 6) + _planes(local, 3) + _planes(after[lo:hi], 4)
            yield int(i), [fps[t] for t in here], [sizes[t] for t in here], zstandard.compress(raw, 1)
        heads = [np.concatenate([[n], np.sort(r >> np.uint64(32))]).astype("<u4").tobytes() for n, r in zip(sizes, rare)]
        yield buckets + fps[0] % parts, fps, [x for c, h in zip(common, heads) for x in (c, len(h))], b"".join(heads)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, sizes, rare, common, size, seen = [], [], [], [], 0, set()

        def made() -> pa.RecordBatch:
            cells = list(zip(*bundle(fps, sizes, rare, common))) if size else [[]] * 4
            types = pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=["bucket", "fps", "sizes", "cells"])

        for batch in batches:
            for fp, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not raw or fp in seen:
                    continue
                seen.add(fp)
                grams = np.frombuffer(raw, "<u8")
                fps.append(fp)
                sizes.append(len(grams))
                rare.append(prefix(grams, counts.value, threshold))
                common.append(int(counts.value[(grams % np.uint64(PLACES)).astype(np.int64)].sum()))
                size += len(rare[-1])
                if size >= BUNDLE:
                    yield made()
                    fps, sizes, rare, common, size, seen = [], [], [], [], 0, set()
        yield made()

    def lists(held: list[tuple]) -> pa.RecordBatch:
        columns = []
        for fps, sizes, raw in held:
            cells = np.frombuffer(zstandard.decompress(raw), np.uint8)
            m = len(cells) // 13
            local = _numbers(cells[6 * m : 9 * m], 3).astype(np.int64)
            key = np.cumsum(_numbers(cells[: 6 * m], 6), dtype=np.uint64)
            columns.append((key.view(np.int64), np.array(fps)[local], np.array(sizes)[local], _numbers(cells[9 * m :], 4).view(np.int64)))
        key, fp, n, after = (np.concatenate(c) for c in zip(*columns))
        order = np.lexsort((fp, key))
        order = order[np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(fp[order]) != 0)])]
        for _ in range(2):
            key_, n_, after_ = key[order], n[order], after[order]
            lead = np.flatnonzero(np.diff(key_, prepend=-1))
            each = np.diff(lead, append=len(order))
            least, most = (np.repeat(f.reduceat(n_, lead), each) if len(lead) else n_ for f in (np.minimum, np.maximum))
            reach = after_ * ((1 + threshold) / threshold) - n_ + SLACK
            order = order[(np.repeat(each, each) > 1) & (reach >= least) & (most >= n_ * threshold - SLACK)]
        return row(*[pa.array(c[order], pa.int64()) for c in (key, fp, n, after)], pa.nulls(len(order), pa.binary()), pa.nulls(len(order), pa.int64()))

    def heads(fps: list[int], sizes: list[int], raw: bytes) -> pa.RecordBatch:
        ends = np.cumsum([0, *sizes[1::2]]).tolist()
        cells, none = [raw[a:b] for a, b in zip(ends, ends[1:])], pa.nulls(len(fps), pa.int64())
        return row(none, pa.array(fps, pa.int64()), none, none, pa.array(cells, pa.binary()), pa.array(sizes[::2], pa.int64()))

    def row(*arrays: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(arrays), names=["gram", "fp", "n", "after", "head", "common"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for bucket, *cells in zip(*[c.to_pylist() for c in batch.columns]):
                if bucket >= buckets:
                    yield heads(*cells)
                    continue
                if held and bucket != now:
                    yield lists(held)
                    held = []
                now = bucket
                held.append(cells)
        if held:
            yield lists(held)

    bundles = sets.select("fp", "grams").mapInArrow(sent, kinds)
    dealt = bundles.repartition(parts, "bucket").sortWithinPartitions("bucket")
    both = materialize(dealt.mapInArrow(listed, "gram long, fp long, n long, after long, head binary, common long"), "similar-postings")
    named = both.where("head IS NOT NULL").select("fp", F.col("head").alias("grams"), "common")
    return both.where("head IS NULL").select("gram", "fp", "n", "after"), named.dropDuplicates(["fp"])


def prefix_keys(posted: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """``key, fp`` for lists of sets: those that are similar enough have a key in common.

    Sets are classed by size so that similar ones are in one class or in
    neighbours; a set goes to its class and to the next, unless what follows an
    n-gram in it is too little for a partner that large.
    """
    rows = posted.withColumn("class", F.floor(F.log("n") / -math.log(threshold) + SLACK))
    largest = F.col("after") * ((1 + threshold) / threshold) - F.col("n") + SLACK
    reaches = largest >= F.pow(F.lit(1 / threshold), F.col("class") + 1) - 1
    classes = F.when(reaches, F.array("class", F.col("class") + 1)).otherwise(F.array("class"))
    return rows.select("gram", "fp", F.explode(classes).alias("class")).select(F.xxhash64("gram", "class").alias("key"), "fp")


# Links ------------------------------------------------------------------------


def _similar(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar enough; ``sets_of`` gives packed sets."""

    def similar(a: bytes, b: bytes) -> bool:
        hub, grams = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
        place = np.minimum(np.searchsorted(hub, grams), len(hub) - 1)
        common = int((hub[place] == grams).sum())
        return common / (len(grams) + len(hub) - common) >= threshold

    sets = materialize(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("fp"))), "similar-sets")
    return _passing(pairs, sets, similar)


def _plausible(pairs: DataFrame, heads: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose heads leave room for enough common n-grams; no similar pair is lost.

    Of two heads take the one that ends first in the order of rarity: what the sets
    share up to there is in both heads, and what they share after it is in the rest
    of that set.
    """

    def plausible(a: bytes, b: bytes) -> bool:
        hub, head = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
        (n, hub), (m, head) = (int(hub[0]), hub[1:]), (int(head[0]), head[1:])
        if not n or not m or min(n, m) < threshold * max(n, m) - SLACK:
            return False
        place = np.minimum(np.searchsorted(hub, head), len(hub) - 1)
        common = int((hub[place] == head).sum()) + max(n - len(hub), m - len(head))
        return common >= (n + m) * (threshold / (1 + threshold)) - SLACK

    return materialize(_passing(pairs, heads, plausible), "similar-plausible")


def _passing(pairs: DataFrame, sets: DataFrame, passes: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (a, b) that ``passes`` says yes to.

    The partners of an ``a`` are dealt to tasks in parts, each with its set once.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    first = parts.join(sets.withColumnRenamed("fp", "a"), "a")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    first = first.select("a", every, F.lit(0).alias("at"), F.col("a").alias("fp"), "grams")
    others = pairs.join(parts, "a").join(sets.withColumnRenamed("fp", "b"), "b")
    part = F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part")
    others = others.select("a", part, F.lit(1).alias("at"), F.col("b").alias("fp"), "grams")
    both = first.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, name = None, None
        for batch in batches:
            found = []
            for at, fp, raw in zip(*[batch.column(c).to_pylist() for c in ("at", "fp", "grams")]):
                if not at:
                    name, hub = fp, raw
                elif passes(hub, raw):
                    found.append((name, fp))
            a, b = zip(*found) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _with_partners(posted: DataFrame, threshold: float) -> DataFrame:
    """``posted`` without lists of one class, and without sets that no size in their list can be a partner of."""
    per = posted.groupBy("gram").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    reach = F.col("after") * ((1 + threshold) / threshold) - F.col("n") + SLACK
    fits = (F.col("low") != F.col("high")) & (reach >= F.col("least")) & (F.col("most") >= F.col("n") * threshold - SLACK)
    return materialize(posted.join(per, "gram").where(fits).select(*posted.columns), "similar-postings")


def class_links(
    keyed: DataFrame | None,
    sets_of: Callable[[DataFrame], DataFrame],
    threshold: float = SIMILAR,
    by_key: bool = False,
    shared: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """``a, b``: links that join all sets of ``keyed`` (key, fp) that similar candidates connect.

    ``sets_of`` gives packed sets for a table of ``fp``. Each link is of sets that
    are similar themselves; sets of a class may be joined by way of others. With
    ``by_key`` only sets under a common key are compared; it is for keys that similar
    sets may lack. ``shared`` has the lists and heads of all sets, of which those
    without a key are compared too; without ``keyed`` they give the keys.
    """
    keys = prefix_keys(shared[0], threshold) if keyed is None else keyed
    several = keys.groupBy("key").count().where("count > 1").select("key")
    met = materialize(keys.join(several, "key").select("key", "fp"), "similar-met")
    if shared is None:
        sets = sets_of(met.select("fp"))
        counts = sets.sparkSession.sparkContext.broadcast(rarity(sets))
        shared = postings(sets, counts, threshold)
    posted, heads = shared
    commonness, heads = heads.select("fp", "common"), heads.select("fp", "grams")
    hubs = met.join(commonness, "fp").groupBy("key").agg(F.max(F.struct("common", "fp")).alias("h"))
    first = met.join(hubs, "key").select(F.col("h.fp").alias("a"), F.col("fp").alias("b"))
    # Under keys of prefixes, a pair that a hub makes with few of them waits for the second round.
    few = met_at_least(threshold) if keyed is None else 1
    first = first.where("a != b").groupBy("a", "b").count().where(F.col("count") >= few).select("a", "b")
    first = materialize(first, "similar-first")
    first = _plausible(first, heads, threshold)
    found = materialize(_similar(first, sets_of, threshold), "similar-links")
    roots = materialize(components(found), "similar-roots").withColumnRenamed("node", "fp")
    posted = posted.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Lists get smaller, and with them the sizes that are there.
    for _ in range(2):
        posted = _with_partners(posted, threshold)
    a = posted.select("gram", *[F.col(c).alias(f"{c}_a") for c in ("fp", "n", "after", "root")])
    b = posted.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("fp", "n", "after", "root")])
    enough = (F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - SLACK
    meet = (a["gram"] == b["gram"]) & F.expr("root_a < root_b") & (F.least("after_a", "after_b") >= enough)
    pairs = a.join(b, meet).groupBy(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).count()
    pairs = pairs.where(F.col("count") >= met_at_least(threshold)).select("a", "b")
    rest = materialize(pairs, "similar-rest")
    if by_key:
        keys_b = met.withColumnRenamed("fp", "b")
        rest = rest.join(met.withColumnRenamed("fp", "a"), "a").join(keys_b, ["key", "b"], "left_semi").select("a", "b").distinct()
        rest = materialize(rest, "similar-rest")
    rest = _plausible(rest, heads, threshold)
    return materialize(found.unionByName(_similar(rest, sets_of, threshold)), "similar-links")


def all_links(
    sets: DataFrame | Made,
    threshold: float = SIMILAR,
    keyed: DataFrame | None = None,
    counts: np.ndarray | None = None,
    sets_of: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``a, b``: links that join all similar ones of ``sets`` (fp, grams), which may come more than once.

    Hubs are taken under the keys of ``keyed`` (key, fp), else under those of their
    prefixes; what has no key in common is compared all the same. ``counts`` is
    their ``rarity`` and ``sets_of`` gives those of some names, if there is a better way.
    """
    counts = sets.sparkSession.sparkContext.broadcast(rarity(sets) if counts is None else counts)
    return class_links(keyed, sets_of or only(sets), threshold, shared=postings(sets, counts, threshold))


def similar_classes(texts: DataFrame, key: str, column: str, threshold: float = SIMILAR, n: int = GRAM) -> DataFrame:
    """``key``, ``class_id`` and ``class_size`` for each text.

    A class holds the texts that links of at least ``threshold`` connect; its id is
    its smallest key. Null texts are empty, and texts without tokens are one class.
    Equal sets are one row until the end, whatever their number.
    """
    sets = made_sets(texts, key, column, n)
    rows, counts = names_and_rarity(sets, texts.select(key).schema[0].dataType.simpleString())

    def sets_of(fps: DataFrame) -> DataFrame:
        """From one text of each."""
        some = rows.join(fps.distinct(), "fp").groupBy("fp").agg(F.min("id").alias("id"))
        some = materialize(some.select("fp", F.xxhash64("id").alias("place")), "similar-fps")
        made = packed(made_sets(texts, key, column, n, _filter(some.select("place"))))
        made = made.mapInArrow(lambda batches: batches, "fp long, grams binary")
        return made.dropDuplicates(["fp"]).join(some.select("fp"), "fp", "left_semi")

    links = all_links(packed(sets), threshold, counts=counts, sets_of=sets_of)
    roots = materialize(components(links), "similar-roots").withColumnRenamed("node", "fp")
    per_fp = rows.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows"))
    named = per_fp.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = named.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("rows").alias("class_size"))
    of = named.select("fp", "root").join(classes, "root").select("fp", "class_id", "class_size")
    return rows.select("id", "fp").join(of, "fp").select(F.col("id").alias(key), "class_id", "class_size")
