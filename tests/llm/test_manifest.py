"""Merkle manifest and prefix trie against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import merkle, queries, ranks, trie


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified; one tree after the other, level by level."""

    def leaf(*values):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def whole(level):
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for i, p in enumerate(at):
                paths[i].append((level[p ^ 1] if p ^ 1 < len(level) else "", p ^ 1 < p))
                at[i] = p >> 1
            level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0], paths

    groups = {}
    for d, source, lang, n, text in rows:
        changed = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        own = leaf(d, source, lang, n, text)
        used = leaf(d, source, lang, n + 1, text) if changed else own
        groups.setdefault(lang, []).append((d is not None, d or 0, own, used))
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = [whole([x[2] for x in sorted(groups[lang])]) for lang in order]
    root, tops = whole([t[0] for t in trees]) if trees else (None, [])
    out = []
    for lang, (sub, paths), top in zip(order, trees, tops):
        for (known, d, own, used), path in zip(sorted(groups[lang]), paths):
            now = used
            for s, left in path + top:
                now = h(s, now) if left else h(now, s)
            out.append((d if known else None, own, sub, root, h(*[s for s, _ in path + top]), now, now == root))
    return out


def table(spark, rows, path):
    kinds = "doc_id long, source string, lang string, n_chars long, text string, rank long, g string, path binary"
    spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], kinds).write.parquet(f"{path}/documents.parquet")
    return str(path)


def sorted_(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("block", [12, 2, 1])
def test_manifest(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i, "web", rng.choice(["en"] * 6 + ["ä", "zz", None]), i, "t" * (i % 5)) for i in range(230)]
    rows += [(1000, None, "lone", None, None), (None, "s", "en", 3, "x"), (None, None, "en", None, None), rows[5], rows[5]]
    rows += [(7, "other", "en", 1, "same id"), (-3, "s", "en", 2, "ß\0\n"), (2000, "s", "", 2, "x" * 100_000)]
    got = queries.op11_merkle(spark, table(spark, rows, tmp_path)).collect()
    assert sorted_(got) == sorted_(brute_manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_small_manifests(spark, tmp_path, n):
    rows = [(i, "s", "en", 1, "a") for i in range(n)]
    assert sorted_(queries.op11_merkle(spark, table(spark, rows, tmp_path)).collect()) == sorted_(brute_manifest(rows))


@pytest.mark.parametrize("height", range(8))
def test_layout(height):
    """Every place is used once, and each aligned subtree below the cut at half the height is one stretch."""
    places = merkle.addresses(height)
    assert sorted(np.concatenate(places).tolist()) == list(range((2 << height) - 1))
    below = height // 2
    for tree in range(1 << (height - below) if height else 0):
        part = np.concatenate([places[v][tree << (below - v) : (tree + 1) << (below - v)] for v in range(below + 1)])
        assert part.max() - part.min() + 1 == len(part) == (2 << below) - 1


def test_heights_halve():
    assert merkle.heights(1) == [0] and merkle.heights(4096) == [12] and merkle.heights(1 << 30) == [8, 7, 8, 7]


def test_ranks_of_a_group_in_many_ranges(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") < 2500, "hot").otherwise(F.col("id").cast("string")).alias("g"),
        (F.col("id") * 7919 % 1000).alias("o"),
        "id",
    )
    got, seen = ranks.ranked(rows, "g", "o", "id").orderBy("g", "rank").collect(), {}
    for r in got:
        seen.setdefault(r.g, []).append((r.rank, r.o, r.id))
    assert sum(map(len, seen.values())) == 3000
    for rows in seen.values():
        assert [r[0] for r in rows] == list(range(len(rows)))
        assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)


# Conversations ----------------------------------------------------------------


def brute_nodes(rows):
    own, found = {}, {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    for c in own:
        taken = zlib.crc32(str(c).encode()) % 4
        seq = own.get(c - c % 20, [])[:taken] + own[c][taken:]
        for d in range(len(seq) + 1):
            members, ends, kids = found.setdefault(tuple(seq[:d]), ([], [], set()))
            members.append(c)
            if d < len(seq):
                kids.add(seq[d])
            else:
                ends.append(c)
    below = {k: [int(not n[2]), (len(n[0]) - 1) * len(k[-1][1].encode().split()) if k else 0] for k, n in found.items()}
    for k in sorted(found, key=len, reverse=True):
        if k:
            below[k[:-1]] = [a + b for a, b in zip(below[k[:-1]], below[k])]
    return [
        (min(m), len(k), min(found[k[:-1]][0]) if k else None, len(m), len(kids), *below[k], h(",".join(map(str, sorted(e)))))
        for k, (m, e, kids) in found.items()
    ]


KINDS = "conv_id long, turn long, role string, text string, pos long, s int, low long"


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], KINDS)


@pytest.mark.parametrize("segment, shard, run", [(512, 5, 2), (3, 4, 2), (2, 10, 1), (4, 100_000, 100)])
def test_nodes(spark, segment, shard, run):
    rng, rows = random.Random(segment), []
    for c in [*range(60), 1000, 1001, 77777]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 14])):
            text = rng.choice(["x y", "z", None, "", "w w w", "é\x0bè\u3000ü"]) if rng.random() < 0.5 else "same old"
            turn = rng.choice([t, t, t, None]) if c % 3 == 0 else t
            rows.append((c, turn, rng.choice(["u", "a", None]) if c % 5 == 0 else "u", text))
    rows += [(None, 1, "u", "lost"), (5, 1, "u", "x y"), (5, 1, "u", "x y")]
    got = trie.nodes(talks(spark, rows), segment=segment, shard=shard, run=run).collect()
    assert sorted_(got) == sorted_(brute_nodes(rows))


def test_one_conversation_of_many_turns_and_many_copies(spark):
    rows = [(20, t, "u", f"turn {t}") for t in range(3000)] + [(c, 0, "u", "hi") for c in range(400, 900)]
    got = trie.nodes(talks(spark, rows), segment=64, shard=100, run=7).collect()
    assert sorted_(got) == sorted_(brute_nodes(rows))


def test_no_turns(spark):
    assert trie.nodes(talks(spark, [])).count() == 0


def test_double_array():
    rng = random.Random(1)
    rows = sorted({tuple(rng.randrange(1, 40) for _ in range(rng.randrange(6))) for _ in range(500)})
    t = trie.DoubleArray([np.array(r, np.int64) for r in rows])
    ways = {r: t.walk(list(r)) for r in rows}
    prefixes = {r[:d]: way[d] for r, way in ways.items() for d in range(len(r) + 1)}
    assert len(set(prefixes.values())) == len(prefixes) == len(t.slots)
    for r, at in prefixes.items():
        if r:
            assert t.check[at] == prefixes[r[:-1]] and t.base[t.check[at]] + r[-1] == at
    with pytest.raises(KeyError):
        t.walk([41])
