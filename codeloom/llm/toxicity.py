"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as two vectors: its own, if it is in the learned vocabulary, and the
mean of its character trigrams' vectors. The network reads windows of ``WINDOW``
words that overlap by half and cover the whole text; the window that scores
highest decides, and a logistic curve, fitted on the training documents, turns
its value into a score. The network is trained in numpy, with Adam, on a bounded
sample. A document's label holds for its highest window, which is chosen again
while training goes on; vectors start from the words' log-odds.

Null texts count as empty; a text without words is one empty window. Without
labels of both kinds every score is 0. Repeated rows each get a score.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import columns, map_rows, remainder, shared

WINDOW, STRIDE = 32, 16
#: Size of a word's and of a trigram's vector, hidden units of a direction, units of the attention.
VECTOR, HIDDEN, ATTENTION = 8, 8, 8
#: Rows of the trigram table, words of the vocabulary, documents in which a word must be.
TRIGRAMS, VOCABULARY, DOCUMENTS = 1 << 13, 20_000, 3
#: Labelled documents of each kind that are learned from, and the code points that they may have.
SAMPLE, LONGEST = 1_500, 20_000
EPOCHS, BATCH, RATE, SEED = 5, 128, 0.004, 3
#: Words whose vectors a task remembers, windows that are scored at once.
REMEMBERED, AT_ONCE = 200_000, 2048

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words' trigrams, and where each word's start; every word has at least one."""
    raw = np.frombuffer(("".join(f"\x02{w}\x03" for w in words)).encode("utf-8", "replace"), np.uint8).astype(np.int64)
    heads, tails = np.flatnonzero(raw == 2), np.flatnonzero(raw == 3)
    rows = (raw[:-2] * 7919 + raw[1:-1] * 104729 + raw[2:] * 1299709) % TRIGRAMS
    inside = np.ones(len(rows), bool)
    cut = np.concatenate([tails - 1, tails])
    inside[cut[cut < len(rows)]] = False
    starts = np.concatenate([[0], np.cumsum(inside)])[heads]
    return rows[inside], starts


def windows(n: int) -> list[tuple[int, int]]:
    """Where the windows over n words start and end."""
    return [(s, min(s + WINDOW, n)) for s in range(0, max(1, n - STRIDE), STRIDE)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, the forward pass and, for training, the gradients."""

    def __init__(self, vocabulary: dict[str, int], word_odds: np.ndarray, trigram_odds: np.ndarray, seed: int = SEED):
        rng, f = np.random.default_rng(seed), np.float32
        d, h, q = 2 * VECTOR, HIDDEN, ATTENTION
        self.vocabulary, self.slope, self.offset = vocabulary, 1.0, 0.0
        self.p = {
            "words": rng.normal(0, 0.1, (len(vocabulary) + 1, VECTOR)).astype(f),
            "chars": rng.normal(0, 0.1, (TRIGRAMS, VECTOR)).astype(f),
            "x": rng.normal(0, d**-0.5, (2, d, 3 * h)).astype(f),
            "bx": np.zeros((2, 1, 3 * h), f),
            "u": rng.normal(0, h**-0.5, (2, h, 3 * h)).astype(f),
            "a": rng.normal(0, (2 * h) ** -0.5, (2 * h, q)).astype(f),
            "ba": np.zeros(q, f),
            "v": rng.normal(0, q**-0.5, q).astype(f),
            "w": rng.normal(0, (2 * h) ** -0.5, 2 * h).astype(f),
            "b": np.zeros(1, f),
        }
        self.p["words"][0] = 0
        self.p["words"][1:, 0] = word_odds
        self.p["chars"][:, 0] = trigram_odds

    def vectors(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vectors of distinct words, and what their gradients need."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        rows, starts = trigrams(words)
        sizes = np.diff(np.concatenate([starts, [len(rows)]]))[:, None]
        chars = np.add.reduceat(self.p["chars"][rows], starts, axis=0) / sizes
        return np.hstack([self.p["words"][ids], chars]).astype(np.float32), (ids, rows, sizes)

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        """What each word adds to the gates, in both directions; the first row is for no word."""
        out = np.matmul(vectors[None], self.p["x"]) + self.p["bx"]
        return np.concatenate([np.zeros((2, 1, out.shape[2]), np.float32), out], axis=1)

    def run(self, gates: np.ndarray, at: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Values of windows; ``at``: their words as rows of ``gates``, 0 where they have no more."""
        p, (n, steps), h = self.p, at.shape, HIDDEN
        mask = (at > 0).astype(np.float32)
        states = np.zeros((2, steps, n, h), np.float32)
        state = np.zeros((2, n, h), np.float32)
        for k in range(steps):
            both = (k, steps - 1 - k)
            x = np.stack([gates[i][at[:, t]] for i, t in enumerate(both)])
            m = np.stack([mask[:, t] for t in both])[:, :, None]
            r = np.matmul(state, p["u"])
            zr = _sigmoid(x[:, :, : 2 * h] + r[:, :, : 2 * h])
            z, reset = zr[:, :, :h], zr[:, :, h:]
            new = np.tanh(x[:, :, 2 * h :] + reset * r[:, :, 2 * h :])
            after = state + m * (1 - z) * (new - state)
            if keep is not None:
                keep.append((state, z, reset, new, r[:, :, 2 * h :], m))
            state = after
            states[0, both[0]], states[1, both[1]] = state
        seen = np.concatenate([states[0], states[1]], axis=2).transpose(1, 0, 2)
        hidden = np.tanh(seen @ p["a"] + p["ba"])
        raw = np.where(mask > 0, hidden @ p["v"], -1e9)
        share = np.exp(raw - raw.max(axis=1, keepdims=True)) * mask
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-9)
        pooled = (share[:, :, None] * seen).sum(axis=1)
        if keep is not None:
            keep.append((seen, hidden, share, pooled))
        return pooled @ p["w"] + p["b"][0]

    def gradients(self, words: list[str], at: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, dict]:
        """Weighted log loss of windows over distinct words, and its gradients."""
        p, h, keep = self.p, HIDDEN, []
        vectors, (ids, rows, sizes) = self.vectors(words)
        gates = self.inputs(vectors)
        value = self.run(gates, at, keep)
        prob = _sigmoid(value)
        loss = -(weights * np.where(y > 0, np.log(prob + 1e-9), np.log(1 - prob + 1e-9))).sum() / weights.sum()
        dv = (weights * (prob - y) / weights.sum()).astype(np.float32)
        seen, hidden, share, pooled = keep.pop()
        g = {"w": pooled.T @ dv, "b": np.array([dv.sum()], np.float32)}
        dpool = dv[:, None] * p["w"]
        dseen = share[:, :, None] * dpool[:, None]
        dshare = (dpool[:, None] * seen).sum(axis=2)
        draw = share * (dshare - (share * dshare).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nt,ntq->q", draw, hidden)
        dhid = draw[:, :, None] * p["v"] * (1 - hidden**2)
        g["a"] = np.einsum("nth,ntq->hq", seen, dhid)
        g["ba"] = dhid.sum(axis=(0, 1))
        dseen += dhid @ p["a"].T
        steps, dgates = at.shape[1], np.zeros_like(gates)
        g["u"], dstate = np.zeros_like(p["u"]), np.zeros((2, len(at), h), np.float32)
        for k in reversed(range(steps)):
            state, z, reset, new, rn, m = keep.pop()
            both = (k, steps - 1 - k)
            dafter = dstate + np.stack([dseen[:, both[0], :h], dseen[:, both[1], h:]])
            dnew = dafter * m * (1 - z) * (1 - new**2)
            dz = -dafter * m * (new - state) * z * (1 - z)
            dreset = dnew * rn * reset * (1 - reset)
            dx = np.concatenate([dz, dreset, dnew], axis=2)
            dr = np.concatenate([dz, dreset, dnew * reset], axis=2)
            g["u"] += np.matmul(state.transpose(0, 2, 1), dr)
            dstate = dafter * (1 - m * (1 - z)) + np.matmul(dr, p["u"].transpose(0, 2, 1))
            for i, t in enumerate(both):
                np.add.at(dgates[i], at[:, t], dx[i])
        dgates = dgates[:, 1:]
        g["x"] = np.matmul(vectors.T[None], dgates)
        g["bx"] = dgates.sum(axis=1, keepdims=True)
        dvec = np.matmul(dgates, p["x"].transpose(0, 2, 1)).sum(axis=0)
        g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(g["words"], ids, dvec[:, :VECTOR])
        g["words"][0] = 0
        np.add.at(g["chars"], rows, np.repeat(dvec[:, VECTOR:] / sizes, sizes[:, 0], axis=0))
        return float(loss), g


class Scorer:
    """Scores whole texts; remembers what words add to the gates."""

    def __init__(self, network: Network):
        self.network, self.rows = network, {}
        self.gates = np.zeros((2, 1, 3 * HIDDEN), np.float32)

    def values(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The value of each window of each text."""
        if len(self.rows) > REMEMBERED:
            self.rows, self.gates = {}, self.gates[:, :1]
        fresh = list({w for t in texts for w in t if w not in self.rows})
        if fresh:
            first = len(self.rows) + 1
            self.rows.update(zip(fresh, range(first, first + len(fresh))))
            self.gates = np.concatenate([self.gates, self.network.inputs(self.network.vectors(fresh)[0])[:, 1:]], axis=1)
        counts, at = [], []
        for t in texts:
            ids = np.fromiter((self.rows[w] for w in t), np.int64, len(t))
            spans = windows(len(t))
            padded = np.zeros(spans[-1][0] + WINDOW, np.int64)
            padded[: len(ids)] = ids
            at.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
            counts.append(len(spans))
        all_at = np.concatenate(at)
        value = np.concatenate(
            [self.network.run(self.gates, all_at[i : i + AT_ONCE]) for i in range(0, len(all_at), AT_ONCE)]
        )
        return np.split(value, np.cumsum(counts)[:-1])

    def scores(self, texts: list[str | None]) -> list[float]:
        top = np.array([v.max() for v in self.values([words_of(t) for t in texts])], float)
        return _sigmoid(self.network.slope * top + self.network.offset).tolist()


def _odds(texts: list[Counter | set], y: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log-odds that a text with an item has label 1, by item number."""
    counts = np.zeros((2, size))
    for t, label in zip(texts, y):
        counts[int(label), list(t)] += 1
    sums = np.array([(y == 0).sum(), (y == 1).sum()])[:, None]
    odds = np.log((counts + 0.5) / (sums + 1))
    return (odds[1] - odds[0]).clip(-4, 4)


def train(texts: list[str], y: np.ndarray) -> Network | None:
    """None unless both labels are there."""
    y = np.asarray(y, float)
    if len(set(y.tolist())) < 2:
        return None
    docs = [words_of(t) for t in texts]
    frequency = Counter(w for d in docs for w in set(d))
    common = sorted((w for w, n in frequency.items() if n >= DOCUMENTS), key=lambda w: (-frequency[w], w))[:VOCABULARY]
    vocabulary = {w: i + 1 for i, w in enumerate(common)}
    word_odds = _odds([{vocabulary[w] - 1 for w in set(d) if w in vocabulary} for d in docs], y, len(vocabulary))
    distinct = list(frequency)
    rows, starts = trigrams(distinct)
    own = dict(zip(distinct, np.split(rows, starts[1:])))
    trigram_odds = _odds([set(np.concatenate([own[w] for w in set(d)]).tolist()) if d else set() for d in docs], y, TRIGRAMS)
    network, rng = Network(vocabulary, word_odds, trigram_odds), np.random.default_rng(SEED)
    odds = {w: word_odds[i - 1] for w, i in vocabulary.items()}
    values = [np.array([sum(odds.get(w, 0.0) for w in d[a:b]) for a, b in windows(len(d))]) for d in docs]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.p.items()}
    step, balance = 0, np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for epoch in range(EPOCHS):
        if epoch >= 2:
            scorer = Scorer(network)
            values = [v for i in range(0, len(docs), 200) for v in scorer.values(docs[i : i + 200])]
        chosen = [(i, int(v.argmax())) for i, v in enumerate(values)]
        chosen += [(i, int(rng.integers(len(v)))) for i, v in enumerate(values) if y[i] == 0]
        order = rng.permutation(len(chosen))
        for lo in range(0, len(order), BATCH):
            picked = [chosen[j] for j in order[lo : lo + BATCH]]
            spans = [docs[i][k * STRIDE : k * STRIDE + WINDOW] for i, k in picked]
            words = sorted({w for s in spans for w in s})
            if not words:
                continue
            number = {w: n + 1 for n, w in enumerate(words)}
            at = np.zeros((len(spans), WINDOW), np.int64)
            for r, s in enumerate(spans):
                at[r, : len(s)] = [number[w] for w in s]
            own_docs = [i for i, _ in picked]
            _, g = network.gradients(words, at, y[own_docs], balance[own_docs])
            step += 1
            for k, v in g.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                rate = RATE * (0.3 if epoch >= EPOCHS - 2 else 1.0)
                network.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    scorer = Scorer(network)
    top = np.array([v.max() for i in range(0, len(docs), 200) for v in scorer.values(docs[i : i + 200])])
    network.slope, network.offset = _logistic(top, y)
    return network


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a small penalty."""
    a, w = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(a @ w)
        h = a.T @ (a * (p * (1 - p))[:, None]) + 0.05 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, a.T @ (p - y) + 0.05 * w), -2, 2)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: int = 0, of: int = 5) -> Network | None:
    """From at most ``SAMPLE`` documents with each label, those with the smallest hashes, outside the held-out rows.

    They are chosen among those that have a text, of up to ``LONGEST`` code points
    first. Of longer texts the start is learned from. An id counts once, with the
    text of the smallest hash, however often it is in either table.
    """
    known = columns(labels, doc_id="doc_id", y=label).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.where(remainder(F.col("doc_id"), of) != held_out).groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = columns(docs, doc_id="doc_id", text="text").where("text IS NOT NULL")
    lengths = rows.groupBy("doc_id").agg(F.min(F.length("text")).alias("length"))
    chosen = known.join(lengths, "doc_id")
    picked = None
    for value in (0, 1):
        order = F.col("length") > LONGEST, F.xxhash64("doc_id"), "doc_id"
        part = chosen.where(F.col("y") == value).orderBy(*order).limit(SAMPLE)
        picked = part if picked is None else picked.unionByName(part)
    some = rows.join(F.broadcast(picked), "doc_id")
    cut = F.struct(F.length("text") > LONGEST, F.xxhash64("text"), F.substring("text", 1, LONGEST).alias("text"))
    sample = some.groupBy("doc_id", "y").agg(F.min(cut)["text"].alias("text")).collect()
    sample = sorted((r["doc_id"], r["text"], int(r["y"])) for r in sample)
    return train([r[1] for r in sample], np.array([r[2] for r in sample]))


@functools.lru_cache(maxsize=1)
def _scorer(name: int, held) -> Scorer:
    return Scorer(held.value)


def predict(docs: DataFrame, network: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score``; a score for every row."""
    rows = columns(docs, doc_id=doc_id, text=text)
    if network is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    held, kind = shared(docs, network), rows.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        scorer, ids, texts, size = _scorer(held.id if hasattr(held, "id") else 0, held), [], [], 0

        for d, t in it:
            ids.append(d)
            texts.append(t)
            size += len(t or "")
            if size > 1 << 19:
                yield from zip(ids, scorer.scores(texts))
                ids, texts, size = [], [], 0
        if ids:
            yield from zip(ids, scorer.scores(texts))

    return map_rows(rows, run, f"doc_id {kind}, score double")
