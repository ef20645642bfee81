"""Merkle manifest of a dataset, in blocks with a van Emde Boas layout.

Rows are leaves of one tree for each value of a group column, in the order of an
id; the groups' roots, in order, are the leaves of one more tree. A node is the
hash of two consecutive ones below it, or of one where the last has no
neighbour, up to the single node that is left.

A tree is cut at half its height into aligned subtrees, and these again, down to
blocks of at most ``BLOCK`` levels. A block is one row: the nodes of its subtree
lie in one array in the same recursive order, so that a path from a leaf to the
block's root crosses few stretches of memory whatever the size of a cache. The
place of a node follows from its level and index by arithmetic alone
(``address``). Block roots are the leaves of the blocks above them. Siblings are
read from above to below: a block hands each of its leaves the siblings on the
leaf's way to the dataset's root, and the block below puts its own before them.

Nulls: a null value of a field is ``-``; a null group is a group and comes first;
null ids come first in their group. Rows that tie in the id are ordered by their
digests; equal rows take neighbouring places. An empty table has no leaves and no
root. Only named columns are read, so others cannot clash. Long texts are hashed
by Spark where they lie. A block of at most 2 ** ``BLOCK`` leaves is in memory.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_rows
from codeloom.llm.ranks import ranked
from codeloom.session import materialize

#: Most levels of a block above its leaves.
BLOCK = 12
SIZE = 32


def digest(*fields: Column) -> Column:
    """SHA-256 (lower-case hex) of fields as ``bytes:value``, or ``-``, one after the other."""

    def written(f: Column) -> Column:
        s = f.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(written, fields)), 256)


def joint(*hex_digests: str) -> str:
    return hashlib.sha256("".join(hex_digests).encode()).hexdigest()


# Layout -----------------------------------------------------------------------


@functools.cache
def addresses(height: int) -> list[np.ndarray]:
    """For each level from the leaves (0) to the root (``height``): the places of its nodes in the layout."""
    return [address(level, np.arange(1 << (height - level)), height) for level in range(height + 1)]


def address(level: int, index: np.ndarray, height: int) -> np.ndarray:
    """The places of nodes of one level in a complete tree of ``height`` levels above its leaves.

    The upper half of the levels is stored first, then the subtrees below it one after the other.
    """
    if height == 0:
        return np.zeros_like(index)
    below = height // 2
    # Subtrees of ``below`` levels hang from the leaves of the upper part.
    if level > below:
        return address(level - below - 1, index, height - below - 1)
    upper, each = (1 << (height - below)) - 1, (1 << (below + 1)) - 1
    tree = index >> (below - level)
    return upper + tree * each + address(level, index - (tree << (below - level)), below)


def heights(leaves: int) -> list[int]:
    """Levels of the blocks from below to above for a tree of so many leaves: halves, until each fits a block."""

    def halved(h: int) -> list[int]:
        return [h] if h <= BLOCK else halved(h - h // 2) + halved(h // 2)

    return halved(max(0, leaves - 1).bit_length())


def built(leaves: np.ndarray, height: int) -> np.ndarray:
    """A block's nodes in the layout, from its leaves' digests (n x 32 bytes); absent nodes are zero."""
    places = addresses(height)
    nodes = np.zeros(((2 << height) - 1, SIZE), np.uint8)
    level = [bytes(x).hex() for x in leaves]
    nodes[places[0][: len(level)]] = leaves
    for up in range(1, height + 1):
        level = [joint(*level[i : i + 2]) for i in range(0, len(level), 2)]
        raw = np.frombuffer(bytes.fromhex("".join(level)), np.uint8)
        nodes[places[up][: len(level)]] = raw.reshape(-1, SIZE)
    return nodes


def siblings(nodes: np.ndarray, count: int, height: int) -> np.ndarray:
    """The steps of all leaves to the block's root: (count, height, 33) bytes.

    The first byte of a step is 0 if there is no sibling, 1 if it stands to the
    left and 2 if to the right; the others are its digest.
    """
    places, out = addresses(height), np.zeros((count, height, 1 + SIZE), np.uint8)
    for level in range(height):
        own = np.arange(count) >> level
        other = own ^ 1
        there = np.flatnonzero(other <= (count - 1) >> level)
        out[there, level, 0] = 1 + (other > own)[there]
        out[there, level, 1:] = nodes[places[level][other[there]]]
    return out


def fold(leaf: str, path: bytes) -> tuple[str, str]:
    """The root that a leaf (hex) and the steps of its path lead to, and the joint hash of the siblings."""
    shown = []
    for at in range(0, len(path), 1 + SIZE):
        one = path[at + 1 : at + 1 + SIZE].hex() if path[at] else ""
        shown.append(one)
        leaf = joint(one, leaf) if path[at] == 1 else joint(leaf, one)
    return leaf, joint(*shown)


# Tables -----------------------------------------------------------------------


def blocks(nodes: DataFrame, height: int, name: str) -> DataFrame:
    """``nodes`` (g, rank, digest, row) to blocks of ``height`` levels in a written table.

    A row holds ``g, block, n, height, alone, nodes, rows, root``; ``rows`` names
    the leaves. A group with one block ends there, with as few levels as it needs.
    """
    one = nodes.groupBy("g").agg(F.max("rank").alias("top"))
    kind = nodes.schema["g"].dataType.simpleString()
    row = nodes.schema["row"].dataType.simpleString()
    block = F.shiftright("rank", height).alias("block")
    given = nodes.join(one.withColumnRenamed("g", "of"), F.col("g").eqNullSafe(F.col("of")))
    given = given.select("g", block, "rank", "top", "digest", "row")
    given = given.repartition("g", "block").sortWithinPartitions("g", "block", "rank")

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        at, held, rows, top = None, [], [], 0

        def done() -> Iterator[tuple]:
            if at is not None:
                alone = top >> height == 0
                levels = top.bit_length() if alone else height
                nodes = built(np.frombuffer(b"".join(held), np.uint8).reshape(-1, SIZE), levels)
                yield *at, len(held), levels, alone, nodes.tobytes(), rows, nodes[addresses(levels)[levels][0]].tobytes()

        for g, b, _, t, d, r in it:
            if (g, b) != at:
                yield from done()
                at, held, rows, top = (g, b), [], [], t
            held.append(d)
            rows.append(r)
        yield from done()

    schema = f"g {kind}, block long, n int, height int, alone boolean, nodes binary, rows array<{row}>, root binary"
    return materialize(map_rows(given, run, schema), name)


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from below to above, and ``g, root`` of each group; ``nodes`` as for ``blocks``."""
    most = nodes.agg(F.max("rank")).first()[0]
    tables = []
    for height in heights((most or 0) + 1):
        tables.append(blocks(nodes, height, "merkle-blocks"))
        last = tables[-1].where("NOT alone")
        nodes = last.select("g", F.col("block").alias("rank"), F.col("root").alias("digest"), F.col("block").alias("row"))
    roots = functools.reduce(DataFrame.unionByName, [t.where("alone").select("g", "root") for t in tables])
    return tables, roots


def paths(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """``g, row, leaf, path, root`` for each leaf of the lowest table.

    ``above`` has ``g, path, root``: what follows a group's own path, and the
    whole tree's root.
    """
    over = None
    for table in reversed(tables):
        ends = table.where("alone").join(above.withColumnRenamed("g", "of"), F.col("g").eqNullSafe(F.col("of"))).drop("of")
        if over is not None:
            on = over.select(F.col("g").alias("of"), F.col("row").alias("at"), "path", F.col("top"))
            inner = table.where("NOT alone").drop("root")
            inner = inner.join(on, F.col("g").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).drop("of", "at")
            ends = ends.drop("root").withColumnRenamed("whole", "top").unionByName(inner)
        else:
            ends = ends.drop("root").withColumnRenamed("whole", "top")
        over = _handed_down(ends)
        if table is not tables[0]:
            over = materialize(over, "merkle-paths")
    return over


def _handed_down(table: DataFrame) -> DataFrame:
    kind = table.schema["g"].dataType.simpleString()
    row = table.schema["rows"].dataType.elementType.simpleString()

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for g, n, height, nodes, rows, path, top in it:
            held = np.frombuffer(nodes, np.uint8).reshape(-1, SIZE)
            leaves, steps = held[addresses(height)[0][:n]], siblings(held, n, height)
            for i, r in enumerate(rows):
                yield g, r, leaves[i].tobytes(), steps[i].tobytes() + path, top

    wanted = table.select("g", "n", "height", "nodes", "rows", "path", "top")
    return map_rows(wanted, run, f"g {kind}, row {row}, leaf binary, path binary, top binary")


def manifest(leaves: DataFrame, group: str, order: str, leaf: str, *keep: str) -> DataFrame:
    """``group``, ``keep`` columns, ``leaf, subroot, root`` (hex) and ``path`` for each row of ``leaves``.

    ``path`` holds the steps from the leaf to the root, as in ``siblings``.
    """
    named = [F.col(group).alias("g"), F.col(order).alias("o"), F.col(leaf).alias("leaf"), F.struct(*keep).alias("row")]
    given = materialize(leaves.select(*named), "merkle-leaves")
    placed = ranked(given, "g", "o", "leaf", name="merkle-ranked")
    tables, subroots = tree(placed.select("g", "rank", F.unhex("leaf").alias("digest"), "row"))
    subroots = materialize(subroots.withColumn("all", F.lit(0)), "merkle-subroots")
    tops = ranked(subroots, "all", "g", name="merkle-subroots")
    of_groups = tops.select(
        F.col("all").alias("g"), "rank", F.col("root").alias("digest"), F.struct(F.col("g").alias("of")).alias("row")
    )
    upper, whole = tree(of_groups)
    above = paths(upper, whole.select("g", F.lit(b"").alias("path"), F.col("root").alias("whole")))
    above = above.select(
        F.col("row.of").alias("g"), "path", F.col("leaf").alias("subroot"), F.col("top").alias("whole")
    )
    above = materialize(above, "merkle-above")
    out = paths(tables, above.select("g", "path", "whole"))
    named = above.select(F.col("g").alias("of"), "subroot")
    out = out.join(named, F.col("g").eqNullSafe(F.col("of")))
    shown = [F.lower(F.hex(c)).alias(n) for c, n in (("leaf", "leaf"), ("subroot", "subroot"), ("top", "root"))]
    return out.select(F.col("g").alias(group), *[F.col(f"row.{k}").alias(k) for k in keep], *shown, "path")


def verified(rows: DataFrame, leaf: str) -> DataFrame:
    """The rows of ``manifest`` with ``proof_sha256`` and ``folded_root``: what the leaf given and the siblings lead to."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    at, start = rows.columns.index("path"), rows.columns.index(leaf)

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for row in it:
            root, proof = fold(row[start], row[at])
            yield *row, proof, root

    return map_rows(rows, run, f"{kinds}, proof_sha256 string, folded_root string")
