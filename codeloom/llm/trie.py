"""Prefix trie of conversations, in double arrays.

A conversation is a sequence of turns; a node of depth d is a distinct sequence
of first d turns. A turn is a code of 20 bytes (128 bits of the hash of its role
and text, and its number of words), a sequence the codes one after the other, so
that the order of its bytes is an order in which each node's members lie together.

Sequences longer than ``SEGMENT`` turns are cut, and each later segment belongs
to the trie of the prefix before it, so no row holds more. Equal segments of one
trie are counted first. The rest is dealt to shards, ranges of that order. In a
shard the turns are numbered densely and packed into the arrays BASE and CHECK:
the child of slot s by turn c is slot BASE[s] + c if CHECK there is s. Walks from
the root count members, and CHECK leads sums back from children to parents.

Only nodes on the first and the last way through a shard can be in another shard
too. They carry a name, and what shards know of them is summed up; a shard leaves
a node to the shard before it where a thing may count only once. Trees of
segments are summed up by doubling: each round adds what is twice as far below.

Null turns come before others, null roles and texts are empty; turns with one
number are ordered by role and text. Repeated rows are turns of their own. Rows
without a conversation id belong to none and take no part. An empty table has no
nodes. Only named columns are read, so others cannot clash. No column of a
conversation of any length, nor a node's members, is gathered whole.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import SPACE, columns, map_rows, shared
from codeloom.llm.ranks import ranked
from codeloom.session import materialize

#: Bytes of a turn's code, turns of a segment, and turns that a shard holds at once.
CODE, SEGMENT, SHARD = 20, 512, 200_000
#: Ids in one run of a node's members.
RUN = 1 << 14
#: Turns that a conversation can take over from another, and how conversations are grouped for it.
TAKEN, FAMILY = 4, 20
NO_ENDS = hashlib.sha256(b"").hexdigest()


# Turns and conversations ------------------------------------------------------


def turns(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """``conv_id, pos, code``: each turn's place from 0, and its code in hex."""
    given = columns(conversations, conv_id=conv_id, turn=turn, role=role, text=text).where("conv_id IS NOT NULL")
    role_, text_ = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text_, F.lit(f"[^{SPACE}]+"))
    named = F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    code = F.concat(F.substring(named, 1, 32), F.lpad(F.hex(words), 8, "0"))
    given = materialize(given.select("conv_id", "turn", F.struct(role_, text_).alias("said"), code.alias("code")), "turns")
    placed = ranked(given, "conv_id", "turn", "said", name="turns-placed")
    return placed.select("conv_id", F.col("rank").alias("pos"), "code")


def taken(conv_id: Column) -> Column:
    """How many turns a conversation takes over."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % TAKEN).cast("int")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, code`` of the rebuilt conversations, and all their ids with ``base``, the turns taken over.

    A conversation takes the first turns of the one that its id less the rest by
    ``FAMILY`` names, and goes on with its own turns after as many.
    """
    first = placed.where(F.col("pos") < TAKEN - 1).groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("first")
    )
    ids = placed.select("conv_id").distinct()
    ids = ids.select("conv_id", taken(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("of"))
    ids = ids.join(first.withColumnRenamed("conv_id", "of"), "of", "left")
    base = F.when(F.col("h") > 0, F.slice(F.coalesce("first", F.array().cast("array<string>")), 1, F.greatest("h", F.lit(1))))
    ids = ids.select("conv_id", "h", F.coalesce(base, F.array().cast("array<string>")).alias("base"))
    ids = materialize(ids, "conversations")
    before = ids.select("conv_id", F.posexplode("base").alias("pos", "code"))
    own = placed.join(ids, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.size("base")).alias("pos"), "code")
    return before.select("conv_id", F.col("pos").cast("long").alias("pos"), "code").unionByName(own), ids


# Segments ---------------------------------------------------------------------


def segments(sequences: DataFrame, ids: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, s, trie, onward, ids, last, seg`` in a written table: the segments of each conversation.

    ``trie`` names the prefix before a segment, ``onward`` the one with it, and
    ``seg`` the segment in its trie. A prefix's name has the sums, modulo 2 ** 32,
    of four words of its segments' hashes. An id without turns has one empty segment.
    """
    s = F.floor(F.col("pos") / segment).cast("int").alias("s")
    codes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])
    cut = sequences.groupBy("conv_id", s).agg(F.unhex(F.array_join(codes, "")).alias("ids"))
    cut = materialize(cut, "segments-cut")
    zero = F.array(*[F.lit(0).cast("long")] * 4)
    hashed = F.sha2(F.concat(F.encode(F.col("s").cast("string"), "UTF-8"), F.lit(b":"), F.col("ids")), 256)
    own = F.array(*[F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])
    long = materialize(cut.where("s > 0").select("conv_id").distinct(), "segments-long")
    many = cut.join(long, "conv_id", "left_semi").withColumn("own", own)
    until = Window.partitionBy("conv_id").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = F.array(*[F.pmod(F.sum(F.col("own")[i]).over(until), F.lit(1 << 32)) for i in range(4)])
    many = many.withColumn("sums", sums).withColumn("count", F.max("s").over(Window.partitionBy("conv_id")))
    less = F.zip_with("sums", "own", lambda a, b: F.pmod(a - b, F.lit(1 << 32)))
    many = many.select("conv_id", "s", less.alias("fp"), F.col("sums").alias("next"), "ids", F.expr("s = count").alias("last"))
    one = cut.join(long, "conv_id", "left_anti").withColumn("own", own)
    one = one.select("conv_id", "s", zero.alias("fp"), F.col("own").alias("next"), "ids", F.lit(True).alias("last"))
    none = ids.select("conv_id").join(cut.select("conv_id").distinct(), "conv_id", "left_anti")
    none = none.select("conv_id", F.lit(0).alias("s"), zero.alias("fp"), zero.alias("next"), F.lit(b"").alias("ids"), F.lit(True).alias("last"))
    trie, onward = named(F.col("s"), F.col("fp")), named(F.col("s") + 1, F.col("next"))
    seg = F.sha2(F.concat(F.encode("trie", "UTF-8"), F.lit(b"/"), F.col("ids")), 256)
    whole = many.unionByName(one).unionByName(none)
    whole = whole.select("conv_id", "s", trie.alias("trie"), onward.alias("onward"), "ids", "last")
    return materialize(whole.withColumn("seg", seg), "segments")


def named(s: Column, fp: Column) -> Column:
    """The name of a trie, and of the node that is its root."""
    return F.concat_ws(":", s.cast("string"), F.array_join(F.transform(fp, lambda x: F.hex(x)), "."))


def ends(cut: DataFrame, length: int = RUN) -> DataFrame:
    """``seg, ends``: the hash of the ids that end with each segment, ascending and joined by commas.

    Ids are sorted in ranges and joined to runs; the runs pass through the hash one after the other.
    """
    given = materialize(cut.where("last").select("seg", "conv_id"), "trie-ends")
    dealt = given.repartitionByRange("seg", "conv_id").sortWithinPartitions("seg", "conv_id")

    def runs(it: Iterator[tuple]) -> Iterator[tuple]:
        seg, held = None, []
        for name, c in it:
            if held and (name != seg or len(held) == length):
                yield seg, held[0], ",".join(map(str, held))
                held = []
            seg = name
            held.append(c)
        if held:
            yield seg, held[0], ",".join(map(str, held))

    def hashed(it: Iterator[tuple]) -> Iterator[tuple]:
        seg, h = None, None
        for name, _, text in it:
            if name != seg:
                if h:
                    yield seg, h.hexdigest()
                seg, h = name, hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
        if h:
            yield seg, h.hexdigest()

    joined = map_rows(dealt, runs, "seg string, low long, ids string")
    joined = joined.repartition("seg").sortWithinPartitions("seg", "low")
    return map_rows(joined.select("seg", "low", "ids"), hashed, "seg string, ends string")


# Double arrays ----------------------------------------------------------------


class DoubleArray:
    """A trie of rows of dense numbers (1 and more), sorted and distinct."""

    def __init__(self, rows: list[np.ndarray]):
        children, parents = [[]], [0]
        way: list[int] = [0]
        self.depth = [0]
        before = np.empty(0, np.int64)
        for row in rows:
            n = min(len(row), len(before))
            same = row[:n] == before[:n]
            shared_ = n if same.all() else int(same.argmin())
            del way[shared_ + 1 :]
            for c in row[shared_:].tolist():
                children.append([])
                children[way[-1]].append((c, len(children) - 1))
                self.depth.append(len(way))
                way.append(len(children) - 1)
            before = row
        self._pack(children)

    def _pack(self, children: list[list[tuple[int, int]]]) -> None:
        most = max([c for kids in children for c, _ in kids], default=0)
        size = most + len(children) + 2
        base, check, free = np.zeros(size + most + 1, np.int64), np.full(size + most + 1, -1, np.int64), 1
        slot, check[0] = [0] * len(children), 0
        used = bytearray(len(check))
        used[0] = 1
        for node, kids in enumerate(children):
            if not kids:
                continue
            while free < len(used) and used[free]:
                free += 1
            low, start = kids[0][0], free
            while True:
                while start - low + kids[-1][0] >= len(used):
                    grown = len(used)
                    used += bytearray(grown)
                    base, check = np.append(base, np.zeros(grown, np.int64)), np.append(check, np.full(grown, -1))
                if not any(used[start - low + c] for c, _ in kids):
                    break
                start += 1
            at = slot[node]
            base[at] = start - low
            for c, kid in kids:
                slot[kid] = start - low + c
                used[start - low + c] = 1
                check[start - low + c] = at
        self.base, self.check = base, check
        self.slots = np.array(slot)

    def walk(self, row: list[int]) -> list[int]:
        """The slots from the root to the row's end."""
        base, check, at, out = self.base, self.check, 0, [0]
        for c in row:
            to = int(base[at]) + c
            if not 0 < to < len(check) or check[to] != at:
                raise KeyError(c)
            at = to
            out.append(at)
        return out

    def up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees: from the deepest level on, CHECK names where a value is added."""
        total, depth = values.copy(), np.array(self.depth)
        order = np.argsort(-depth, kind="stable")
        slots, cuts = self.slots[order], np.flatnonzero(np.diff(depth[order])) + 1
        for at in np.split(slots, cuts)[:-1]:
            np.add.at(total, self.check[at], total[at])
        return total


NODE = (
    "key string, up string, depth long, low long, up_low long, n long, kids long, leaves long, "
    "weighed long, once long, ends string"
)


def _node_name(trie: str, ids: bytes, depth: int) -> str:
    return trie if depth == 0 else f"{trie}/{hashlib.sha256(ids[: depth * CODE]).hexdigest()}"


def shard_nodes(trie: str, s: int, rows: list[tuple], before: int, after: int, totals: bool, segment: int) -> Iterator[tuple]:
    """The nodes of one shard of a trie, as ``NODE`` says.

    ``rows`` has (ids, n, n_end, low, ends, next, deeper leaves, weighed, once),
    sorted. ``before`` and ``after`` are the turns that the first row has in
    common with the shard before, and the last one with the shard after; -1 if
    that is of another trie.
    """
    raw = np.frombuffer(b"".join(r[0] for r in rows), f"V{CODE}")
    codes, dense = np.unique(raw, return_inverse=True)
    cuts = np.cumsum([len(r[0]) // CODE for r in rows])
    numbered = np.split(dense.astype(np.int64) + 1, cuts[:-1])
    words = np.frombuffer(codes.tobytes(), np.uint8).reshape(-1, CODE)[:, 16:].copy().view(">u4")[:, 0].astype(np.int64)
    trie_ = DoubleArray(numbered)
    size = len(trie_.check)
    n, low = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    leaves, extra = np.zeros(size, np.int64), np.zeros((size, 2), np.int64)
    last_word, own = np.zeros(size, np.int64), np.zeros(size, bool)
    own[trie_.slots] = True
    closes, first_way, last_way = {}, [], []
    for i, (row, told) in enumerate(zip(numbered, rows)):
        way = np.array(trie_.walk(row.tolist()))
        n[way] += told[1]
        low[way] = np.minimum(low[way], told[3])
        last_word[way[1:]] = words[row - 1]
        end, full = int(way[-1]), len(row) == segment and told[1] > told[2]
        extended = i + 1 < len(rows) and len(rows[i + 1][0]) > len(told[0]) and rows[i + 1][0].startswith(told[0])
        extended = extended or (i + 1 == len(rows) and after >= len(row))
        leaves[end] = told[6] if full else 0 if extended else 1
        if full:
            extra[end] = told[7:9]
        closes[end] = (told[4], told[5] if full else None)
        first_way, last_way = (way if i == 0 else first_way), way
    own[first_way[: before + 1]] = False
    depths = np.zeros(size, np.int64)
    depths[trie_.slots] = trie_.depth
    kids = np.zeros(size, np.int64)
    inner = trie_.slots[1:]
    np.add.at(kids, trie_.check[inner], own[inner].astype(np.int64))
    weighed = trie_.up(n * last_word + extra[:, 0])
    once = trie_.up(own * last_word + extra[:, 1])
    leaves = trie_.up(leaves)
    names = {0: trie}
    names |= {int(x): _node_name(trie, rows[0][0], d) for d, x in enumerate(first_way[: before + 1])}
    names |= {int(x): _node_name(trie, rows[-1][0], d) for d, x in enumerate(last_way[: after + 1])}
    names |= {end: onward for end, (_, onward) in closes.items() if onward}
    if s and not totals:
        # The shard above has this root as a node already; all but its children is counted there.
        n[0] = leaves[0] = weighed[0] = once[0] = 0
    for at in [0] if totals else trie_.slots.tolist():
        up = int(trie_.check[at])
        yield (
            names.get(at), None if at == 0 else names.get(up), s * segment + int(depths[at]), int(low[at]),
            None if at == 0 else int(low[up]), int(n[at]), int(kids[at]), int(leaves[at]), int(weighed[at]),
            int(once[at]), closes[at][0] if at in closes else None,
        )


# Shards -----------------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences start with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // CODE
    x, y = np.frombuffer(a[:n], np.uint8), np.frombuffer(b[:n], np.uint8)
    return int((x != y).argmax()) // CODE


def sharded(distinct: DataFrame, most: int = SHARD) -> DataFrame:
    """Shards of the distinct segments in a written table: ``part, no, trie, s, before, after, first, last, rows``.

    ``before`` and ``after`` are null where they depend on another range.
    """
    told = ["ids", "n", "n_end", "low", "ends", "onward", "leaves", "weighed", "once"]
    dealt = distinct.repartitionByRange("trie", "ids").sortWithinPartitions("trie", "ids").select("trie", "s", *told)

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        part, no, held, size, of, before = TaskContext.get().partitionId(), 0, [], 0, None, None

        def shard(after: int | None) -> tuple:
            return part, no, *of, before, after, held[0][0], held[-1][0], pickle.dumps(held)

        for trie, s, *row in it:
            if held and ((trie, s) != of or size >= most):
                after = _common(held[-1][0], row[0]) if (trie, s) == of else -1
                yield shard(after)
                no, held, size, before = no + 1, [], 0, after
            of = trie, s
            held.append(tuple(row))
            size += len(row[0]) // CODE + 1
        if held:
            yield shard(None)

    schema = "part int, no long, trie string, s int, before int, after int, first binary, last binary, rows binary"
    return materialize(map_rows(dealt, run, schema), "trie-shards")


def _edges(shards: DataFrame) -> dict[int, tuple[int, int]]:
    """For each range: the turns in common with the range before and with the one after; two numbers for each."""
    first = shards.where("before IS NULL").select("part", F.col("trie").alias("first_trie"), "first")
    last = shards.where("after IS NULL").select("part", F.col("trie").alias("last_trie"), "last")
    out, above = {}, None
    for r in first.join(last, "part").orderBy("part").toLocalIterator():
        same = _common(above["last"], r["first"]) if above and above["last_trie"] == r["first_trie"] else -1
        if above:
            out[above["part"]] = (out[above["part"]][0], same)
        out[r["part"]] = (same, -1)
        above = r
    return out


def all_nodes(shards: DataFrame, segment: int = SEGMENT, totals: bool = False) -> DataFrame:
    """The nodes of all shards; with ``totals`` only what each shard knows of its trie's root."""
    edges = shared(shards, _edges(shards))

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for part, trie, s, before, after, rows in it:
            outer = edges.value[part]
            before, after = (outer[0] if before is None else before), (outer[1] if after is None else after)
            yield from shard_nodes(trie, s, pickle.loads(rows), before, after, totals, segment)

    return map_rows(shards.select("part", "trie", "s", "before", "after", "rows"), run, NODE)


SUMS = ["leaves", "weighed", "once"]


def _below(distinct: DataFrame, segment: int, shard: int) -> DataFrame:
    """``onward, leaves, weighed, once``: the sums of each trie of later segments, with all tries below it."""
    added = [F.sum(c).alias(c) for c in SUMS]
    own = all_nodes(sharded(distinct, shard), segment, totals=True).groupBy(F.col("key").alias("trie")).agg(*added)
    parents = distinct.where("n > n_end").select(F.col("onward").alias("trie"), F.col("trie").alias("up"))
    held = materialize(own.join(parents, "trie", "left"), "trie-below")
    while held.where("up IS NOT NULL").limit(1).count():
        more = held.where("up IS NOT NULL").groupBy(F.col("up").alias("trie")).agg(*[F.sum(c).alias(f"more_{c}") for c in SUMS])
        far = held.select(F.col("trie").alias("up"), F.col("up").alias("far"))
        new = held.join(more, "trie", "left").join(far, "up", "left")
        summed = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in SUMS]
        held = materialize(new.select("trie", F.col("far").alias("up"), *summed), "trie-below")
    return held.select(F.col("trie").alias("onward"), *SUMS)


def nodes(conversations: DataFrame, segment: int = SEGMENT, shard: int = SHARD, run: int = RUN, **names: str) -> DataFrame:
    """A row for each node: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    sequences, ids = rebuilt(turns(conversations, **names))
    cut = segments(sequences, ids, segment)
    counted = cut.groupBy("seg", "trie", "s", "onward", "ids").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("last").cast("long")).alias("n_end"), F.min("conv_id").alias("low")
    )
    distinct = materialize(counted.join(ends(cut, run), "seg", "left"), "trie-segments")
    nothing = [F.lit(0).cast("long").alias(c) for c in SUMS]
    flat = distinct.select("*", *nothing)
    if distinct.where("s > 0").limit(1).count():
        below = _below(flat, segment, shard)
        flat = distinct.join(below, "onward", "left").select(*distinct.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in SUMS])
    found = materialize(all_nodes(sharded(flat, shard), segment), "trie-nodes")
    merged = found.where("key IS NOT NULL").groupBy("key").agg(
        *[F.max(c).alias(c) for c in ("up", "depth", "up_low", "ends")],
        F.min("low").alias("low"),
        *[F.sum(c).alias(c) for c in ("n", "kids", *SUMS)],
    )
    merged = materialize(merged, "trie-shared")
    lows = merged.select(F.col("key").alias("up"), F.col("low").alias("shared_low"))
    whole = found.where("key IS NULL").unionByName(merged).join(lows, "up", "left")
    return whole.select(
        F.col("low").alias("conv_id"),
        "depth",
        F.coalesce("shared_low", "up_low").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("weighed") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
