import random
import re

import numpy as np
import xxhash

from codeloom.llm import ann, simhash, substring
from codeloom.operators.components import components
from codeloom.llm.queries import op6_substring, op9_neighbours, op10_simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_removed(rows):
    """Kept words of (doc_id, text) rows, by the order of doc_id and start."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = WORD.findall(t or "")
        gone = set()
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                gone.update(range(s, s + 20))
            seen.add(key)
        out.append((str(d), len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out)


def test_substring_brute_force(docs):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "the"]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = [(1, None), (2, ""), (3, "a b c"), (4, passage), (5, passage), (None, passage), (7, "x " * 300)]
    for i in range(10, 60):
        own = " ".join(rng.choices(vocabulary, k=rng.randrange(5, 120)))
        cut = passage.split()[rng.randrange(20) : rng.randrange(40, 60)]
        rows.append((i, rng.choice([own, f"{own}\n" + " ".join(cut) + "\t" + own, " ".join(cut)])))
    table = docs(rows).coalesce(1)
    for parts, buckets in ((1, None), (5, 3)):
        out = substring.remove_repeats(table.repartition(parts, "doc_id") if parts > 1 else table, buckets=buckets).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in out) == brute_removed(rows)


def test_substring_edges(docs):
    assert substring.remove_repeats(docs([])).count() == 0
    t = " ".join(f"w{i}" for i in range(25))
    out = [(r.doc_id, r.n_removed) for r in substring.remove_repeats(docs([(1, t), (1, t)]).coalesce(1)).collect()]
    assert sorted(out) == [(1, 0), (1, 25)]
    table = docs([(1, f"{t}\n x"), (2, t), (3, None)])
    new = substring.rewritten(table)
    assert new.columns == table.columns
    assert sorted((r.doc_id, r.text, r.row, r.n_words) for r in new.where("text IS NOT NULL").collect()) == [
        (1, f"{t}\n x", "x", 1), (2, "", "x", 1)
    ]


def test_equal_hashes_are_told_apart(monkeypatch):
    """Windows that only share a hash stay."""
    words = [f"w{i}" for i in range(20)]
    a, b = " ".join(words).encode(), " ".join(words[::-1]).encode()
    sent = list(substring._sent({0: [((1, 0, 0), a), ((2, 1, 0), b), ((3, 2, 0), a), ((4, 3, 0), b)]}))
    real = substring._windows
    monkeypatch.setattr(substring, "_windows", lambda *x: (np.zeros(4, np.uint64), *real(*x)[1:]))
    assert list(substring._repeats([sent[0][1]])) == [(2, 0, 20), (3, 0, 20)]


def test_super_kmers_cover_each_window_once():
    h = np.random.default_rng(3).integers(0, 9, 500).astype(np.uint64)
    first, last, low = substring.super_kmers(h)
    assert first[0] == 0 and last[-1] == 480 and (first[1:] == last[:-1] + 1).all()
    again = substring.super_kmers(h[100:160])
    inner = {int(x) for x in again[2]}
    assert inner <= {int(x) for x in low}


def test_substring_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    wanted = {d: (n, gone) for d, n, gone, _ in brute_removed(texts)}
    assert {str(r.doc_id): (r.n_words, r.n_removed) for r in op6_substring(spark, sf).collect()} == wanted


def brute_print(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest node reachable, by index, for fingerprints."""
    u = np.array(prints, np.uint64)
    low = np.arange(len(u))
    near = np.bitwise_count(u[:, None] ^ u[None]) <= 2
    while True:
        new = np.where(near, low[None], len(u)).min(axis=1)
        if (new == low).all():
            return low
        low = new


def test_fingerprints():
    for t in ["", None, "A", "a B", "a b c", "Éa É b c d", "x y z w", "the cat " * 40_000]:
        assert simhash.fingerprint(t) & (2**64 - 1) == brute_print(t)


def test_golay_keys_of_near_words_meet():
    rng = np.random.default_rng(5)
    golay = simhash.Golay()
    a = rng.integers(-(2**63), 2**63 - 1, 3000)
    flips = np.array([np.uint64(1) << np.uint64(i) | np.uint64(1) << np.uint64(j) for i, j in rng.integers(0, 64, (3000, 2))])
    b = (a.view(np.uint64) ^ flips).view(np.int64)
    keys = [[set(k[r == i].tolist()) for i in range(3000)] for k, r in (golay.keys(a), golay.keys(b))]
    assert all(x & y for x, y in zip(*keys)) and max(map(len, keys[0])) <= 18


def test_links_join_all_that_is_near(spark, monkeypatch):
    rng = np.random.default_rng(6)
    fps = set()
    for centre in rng.integers(-(2**63), 2**63 - 1, 60):
        x = np.uint64(int(centre) & (2**64 - 1))
        for _ in range(rng.integers(1, 60)):
            fps.add(int(x.view(np.int64)))
            for _ in range(rng.integers(1, 4)):
                x ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    fps = sorted(fps)
    wanted = brute_components([f & (2**64 - 1) for f in fps])
    table = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(4)
    for bucket in (512, 8):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        roots = {r.node: r.root for r in components(simhash.links(table)).collect()}
        assert [roots.get(f, f) for f in fps] == [fps[i] for i in wanted]


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 6), (-3, -9)]
    out = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, -3: -9, -9: -9}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_edges(docs):
    long = " ".join(f"w{i % 97}" for i in range(30_000))
    rows = [(9, None), (3, ""), (None, " "), (5, "a b c d"), (4, "A b  c D"), (4, "A b  c D"), (6, long), (2, f"{long}\n")]
    out = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(rows)).collect()]
    wanted = {9: 3, 3: 3, None: 3, 5: 4, 4: 4, 6: 2, 2: 2}
    assert len(out) == 8 and all(c == wanted[d] for d, _, c in out)
    assert {f for d, f, _ in out if d in (9, 3, None)} == {"0" * 16}
    kept = simhash.one_of_each(docs(rows).coalesce(1))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == docs(rows).columns
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.one_of_each(docs([])).count() == 0
    assert simhash.one_of_each(docs([(None, "a"), (None, "a")]).coalesce(1)).count() == 1


def test_simhash_query(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    prints = [brute_print(t) for _, t in rows]
    low = brute_components(prints)
    wanted = {d: (f"{p:016x}", rows[i][0]) for (d, _), p, i in zip(rows, prints, low)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op10_simhash(spark, sf).collect()} == wanted


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    out = {}
    for r in op9_neighbours(spark, sf).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        got = sorted(out[ids[q]])
        assert [g[0] for g in got] == list(range(1, 21)) and ids[q] not in [g[1] for g in got]
        assert all(abs(s - float(x[ids == v][0] @ x[q])) < 1e-12 for _, v, s in got)
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        hits += len({g[1] for g in got} & set(ids[order].tolist()))
    assert len(out) == (ids % 20 == 0).sum() and hits >= 0.9 * 20 * len(out)


def test_many_equal_vectors_and_bad_ones(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(1, 100)] + [(200, [0.5, 0.1]), (200, [0.5, 0.1]), (220, [3.0, 4.0])]
    rows += [(300, None), (320, []), (340, [0.0, 0.0]), (360, [nan, 1.0]), (380, [inf, 1.0]), (400, [1.0]), (None, [1.0, 1.0])]
    rows += [(420, [None, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {}
    for r in ann.search(table, ann.F.col("vec_id") % 20 == 0).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(out) == {20, 40, 60, 80, 200, 220}
    assert [v for _, v, _ in sorted(out[20])] == [220, *range(1, 20)]
    assert [v for _, v, _ in sorted(out[220])] == list(range(1, 21))
    assert ann.search(table.where("vec_id = 0"), ann.F.col("vec_id") % 20 == 0).count() == 0
    assert [r.vec_id for r in ann.search(table.where("vec_id >= 200"), ann.F.col("vec_id") == 200).collect()] == [220]


def test_recall_with_thousands_of_lists(spark, monkeypatch):
    """A third of the vectors are one tight cluster, over many more lists than a walk gives."""
    for name, value in (("LIST", 8), ("LISTS", 2000), ("SAMPLE", 12_000)):
        monkeypatch.setattr(ann, name, value)
    rng, n = np.random.default_rng(11), 24_000
    x, centre = rng.normal(size=(n, 64)), rng.normal(size=64)
    x[: n // 3] = centre / np.linalg.norm(centre) + 0.01 * rng.normal(size=(n // 3, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert len(ann.build(table.selectExpr("vec_id AS key", "embedding AS v")).centroids) >= 2000
    found = {q: set() for q in range(0, n, 120)}
    for r in ann.search(table, ann.F.col("vec_id") % 120 == 0).collect():
        found[r.query_id].add(r.vec_id)
    recall = []
    for q in found:
        order = np.argsort(-(x @ x[q]), kind="stable")
        recall.append(len(found[q] & set(order[order != q][:20].tolist())) / 20)
    tight = len(range(0, n // 3, 120))
    print("recall in the cluster and outside:", np.mean(recall[:tight]), np.mean(recall[tight:]))
    assert np.mean(recall[:tight]) >= 0.9 and np.mean(recall[tight:]) >= 0.9


def test_all_lists_are_brute_force(spark, monkeypatch):
    """Without a ratio to stop at, reading the nearest lists first and the rest by the bound loses nothing."""
    for name, value in (("LIST", 8), ("BLOCK", 5), ("QUERIES", 3)):
        monkeypatch.setattr(ann, name, value)
    monkeypatch.setattr(ann.Index, "learned_ratio", lambda *_: 1e9)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) * rng.uniform(0.2, 3, size=(400, 1))
    x[200:260] = x[200]
    rows = [(i, v.tolist(), "a", i % 3) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string, score int")
    got = {}
    for r in ann.search(table, ann.F.col("vec_id") % 7 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 7))
    for q, found in got.items():
        score = (x[q] * x).sum(axis=1)
        order = [int(i) for i in np.lexsort((np.arange(400), -score)) if i != q][:5]
        assert [v for _, v, _ in sorted(found)] == order
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in found)


def test_walk_reads_a_part_of_the_lists():
    """The ratio is learned from vectors of another shape than those of the tables."""
    rng = np.random.default_rng(77)
    x = rng.normal(size=(12_000, 10)) @ rng.normal(size=(10, 48)) + 0.05 * rng.normal(size=(12_000, 48))
    norm = np.sqrt((x**2).sum(axis=1)).max()
    c = ann.centroids_of(ann.lifted(x[:6000], norm), 32)
    index = ann.Index(c, ann.graph_of(c), norm)
    index.ratio = index.learned_ratio(x[:6000], 20)
    postings, probes = index.postings(x), index.probes(x[9000:9200])
    d = np.sqrt(((index.stretched(x[9000:9200])[:, None] - c[None]) ** 2).sum(axis=2))
    within = [set(np.flatnonzero(r <= index.ratio * r.min())) for r in d]
    assert np.mean([len(w & set(p.tolist())) / len(w) for w, p in zip(within, probes)]) >= 0.95
    assert np.mean([len(p) for p in probes]) < 0.4 * len(c)
    score = x[9000:9200] @ x.T
    score[np.arange(200), np.arange(9000, 9200)] = -np.inf
    near = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([bool(set(postings[j]) & set(probes[i])) for i in range(200) for j in near[i]]) >= 0.9
