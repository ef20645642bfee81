"""Classes of similar texts against all pairs."""

import random

import pytest

from codeloom.operators import similar


def grams(text, n=4):
    t = text.split()
    return frozenset(" ".join(t[i : i + n]) for i in range(max(1, len(t) - n + 1))) if t else frozenset()


def brute_classes(rows, threshold):
    sets, low = [grams(t or "") for _, t in rows], list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a & b and len(a & b) / len(a | b) >= threshold):
                low[root(i)] = root(j)
    members = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(root(i), []).append(d)
    return sorted((d, min(m), len(m)) for m in members.values() for d in m)


def found(spark, rows, threshold=0.8, **more):
    table = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "id2 long, body string, fp long, n int, key long")
    return sorted(map(tuple, similar.similar_classes(table.coalesce(1), "id2", "body", threshold, **more).collect()))


def edited(rng, words, edits):
    new = list(words)
    for _ in range(edits):
        at, how = rng.randrange(len(new) + 1), rng.randrange(3)
        if at == len(new):
            new.append("z")
        elif how == 0:
            new[at] = f"x{rng.randrange(40)}"
        elif how == 1:
            del new[at]
        else:
            new.insert(at, f"y{rng.randrange(40)}")
    return new


@pytest.mark.parametrize("threshold", [0.8])
def test_near_copies_and_chains(spark, threshold):
    """Copies of copies: links lead through sets that are far from each other and from the smallest one."""
    rng, rows = random.Random(int(threshold * 100)), []
    for family in range(12):
        words = [f"w{rng.randrange(60 if family % 2 else 3000)}" for _ in range(rng.choice([5, 30, 80, 200]))]
        for _ in range(30):
            rows.append((len(rows), " ".join(words)))
            new = edited(rng, words, rng.choice([0, 1, 1, 2, 6]))
            words = new if len(new) > 3 and rng.random() < 0.5 else words
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "a"), (9004, "a"), (9005, "a b c"), (9006, "a b c d")]
    assert found(spark, rows, threshold) == brute_classes(rows, threshold)


def test_one_large_group_of_near_copies(spark):
    """Members that are far from the hub share what it lacks with some and not with others."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([1, 3, 5, 7])))) for i in range(60)]
    variant = base[:60] + [f"v{i}" for i in range(14)] + base[60:]
    rows += [(600 + i, " ".join(edited(rng, variant, rng.choice([0, 2, 4])))) for i in range(30)]
    assert found(spark, rows) == brute_classes(rows, 0.8)


def test_no_output_grows_with_a_group_squared(spark):
    """Template texts that share most n-grams and are not similar leave few rows in the second round."""
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(shared + [f"u{rng.randrange(10**6)}" for _ in range(40)])) for i in range(600)]
    table = spark.createDataFrame(rows, "id long, body string")
    sets = similar.gram_sets(table, "id", "body")
    packed = similar.packed(sets)
    keyed = sets.selectExpr("1L AS key", "fp")
    assert similar.class_links(keyed, lambda fps: packed.join(fps, "fp", "left_semi")).count() == 0
    assert found(spark, rows) == brute_classes(rows, 0.8)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_pairs_have_a_key_in_common(spark):
    """Similar sets without a common key stay apart where keys are what proposes pairs."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(4)]
    sets = similar.gram_sets(spark.createDataFrame(rows, "id long, body string"), "id", "body")
    packed = similar.packed(sets)
    keyed = sets.selectExpr("id div 2 AS key", "fp")
    name = {r["fp"]: r["id"] for r in sets.collect()}

    def joined(**more):
        found = similar.class_links(keyed, lambda fps: packed.join(fps, "fp", "left_semi"), **more)
        return {frozenset((name[r["a"]], name[r["b"]])) for r in found.collect()}

    assert joined(by_key=True) == {frozenset((0, 1)), frozenset((2, 3))}
    assert len(joined()) > 2


def test_pairs_that_cannot_be_similar_go_by_their_heads(spark, monkeypatch):
    """Sets that share a rare n-gram and little else are never sent whole."""
    seen, checked = [], similar._similar
    monkeypatch.setattr(similar, "_similar", lambda pairs, *more: seen.append(pairs.count()) or checked(pairs, *more))
    rng = random.Random(2)
    rows = [(i, " ".join(["r1 r2 r3 r4", *[f"u{rng.randrange(10**6)}" for _ in range(100)]])) for i in range(20)]
    assert found(spark, rows) == brute_classes(rows, 0.8) and seen == [0, 0]


def test_sets_are_not_written(spark, monkeypatch):
    """Of texts that share nothing, tables hold far less than their n-grams; a set is sent whole only for a pair that its head leaves."""
    written, write = {}, similar.materialize

    def counted(df, name):
        table = write(df, name)
        cells = [c for c, kind in table.dtypes if kind == "binary" or kind.startswith("array")]
        written[name] = sum(table.selectExpr(f"coalesce(sum(octet_length(cast({c} AS binary))), 0) AS n").first()["n"] for c in cells if "array" not in dict(table.dtypes)[c])
        written[name] += sum(8 * table.selectExpr(f"coalesce(sum(size({c})), 0) AS n").first()["n"] for c in cells if "array" in dict(table.dtypes)[c])
        return table

    monkeypatch.setattr(similar, "materialize", counted)
    rng = random.Random(3)
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(300))) for i in range(40)]
    rows.append((40, rows[0][1] + " z"))
    assert found(spark, rows) == brute_classes(rows, 0.8)
    assert sum(written.values()) < 0.3 * 8 * 297 * 40 and written["similar-sets"] < 3 * 8 * 300


def test_lists_of_prefixes_in_many_buckets(spark, monkeypatch):
    """Small bundles and buckets give the same lists: each set with a common n-gram once, and no list of one set."""
    rng, rows = random.Random(4), []
    for i in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(40)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words)), (3 * i + 2, " ".join([*words[:-1], "x"]))]
    table = spark.createDataFrame(rows, "id long, body string").repartition(5)
    sets = similar.packed(similar.gram_sets(table, "id", "body"))
    counts = spark.sparkContext.broadcast(similar.rarity(sets))
    whole = sorted(map(tuple, similar.postings(sets, counts)[0].collect()))
    monkeypatch.setattr(similar, "BUNDLE", 50)
    monkeypatch.setattr(similar, "BUCKET", 100)
    assert sorted(map(tuple, similar.postings(sets, counts)[0].collect())) == whole and len(set(whole)) == len(whole) > 0
    lists = {}
    for gram, fp, _, _ in whole:
        lists.setdefault(gram, set()).add(fp)
    assert min(map(len, lists.values())) > 1
