"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over standardized document
statistics. Each task sums the normal equations of its labelled rows; the sums
are added in two steps, so the driver gets a fixed number of small matrices
however many tasks there are. Scores are calibrated on a bounded sample by
isotonic regression to the share of label 1.

Null texts count as empty. Without labelled rows every score is 0.5. Repeated
rows each get a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import hashed_sample, map_rows, shared
from codeloom.llm.textstats import SHARES

#: Fourier features, inverse of the kernel's width, ridge penalty for each row, seed.
FEATURES, GAMMA, PENALTY, SEED = 384, 0.12, 1e-4, 11
#: Rows of the calibration sample, and the groups in which sums of tasks meet.
CALIBRATION, GROUPS = 20_000, 16


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, z, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.weights
        return np.interp(raw, self.knots, self.values)


def _blocks(it: Iterator[tuple], size: int = 4096) -> Iterator[list[tuple]]:
    held = []
    for row in it:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def fit(examples: DataFrame) -> Model | None:
    """From rows with the statistics and ``y`` in 0 and 1; None without rows."""
    cells = [F.count(F.lit(1))] + [f(c) for c in SHARES for f in (F.avg, F.stddev_pop)]
    n, *moments = examples.agg(*cells).first()
    if not n:
        return None
    mean, scale = np.array(moments[::2]), np.array(moments[1::2])
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(SEED)
    model = Model(
        mean,
        scale,
        rng.normal(0, np.sqrt(2 * GAMMA), (len(SHARES), FEATURES)),
        rng.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(0),
        np.zeros(2),
        np.zeros(2),
    )
    held, width = shared(examples, model), FEATURES + len(SHARES) + 1

    def partial(it: Iterator[tuple]) -> Iterator[tuple]:
        total = np.zeros((width, width + 1))
        for rows in _blocks(it):
            a = np.array(rows, float)
            f = held.value.features(a[:, 1:])
            total += f.T @ np.hstack([f, a[:, :1]])
        yield 0, total.tobytes()

    def added(it: Iterator[tuple]) -> Iterator[tuple]:
        total = None
        for _, raw in it:
            a = np.frombuffer(raw)
            total = a.copy() if total is None else total + a
        if total is not None:
            yield 0, total.tobytes()

    sums = map_rows(examples.select("y", *SHARES), partial, "part int, total binary")
    sums = sums.withColumn("part", (F.spark_partition_id() % GROUPS).cast("int"))
    rows = map_rows(sums.repartition(GROUPS, "part"), added, "part int, total binary").collect()
    total = np.sum([np.frombuffer(r["total"]) for r in rows], axis=0).reshape(width, width + 1)
    gram = total[:, :-1] + PENALTY * n * np.eye(width)
    model.weights = np.linalg.solve(gram, total[:, -1])
    sample = hashed_sample(examples.select("doc_id", "y", *SHARES), CALIBRATION, "doc_id", "doc_id", "y").toPandas()
    raw = model.features(sample[SHARES].to_numpy(float)) @ model.weights
    model.knots, model.values = isotonic(raw, sample["y"].to_numpy(float))
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots rise strictly, values never fall, equal scores are one."""
    knots, where = np.unique(raw, return_inverse=True)
    weights, sums = np.bincount(where).astype(float), np.bincount(where, y)
    blocks: list[list[float]] = []
    for i in range(len(knots)):
        blocks.append([knots[i], knots[i], weights[i], sums[i]])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    ends = [(x, b[3] / b[2]) for b in blocks for x in dict.fromkeys(b[:2])]
    return np.array([e[0] for e in ends]), np.clip([e[1] for e in ends], 0, 1)


def score(stats: DataFrame, model: Model | None, keep: list[str | Column]) -> DataFrame:
    """The ``keep`` columns with ``score``."""
    if model is None:
        return stats.select(*keep, F.lit(0.5).alias("score"))
    kept = stats.select(*keep)
    held, schema = shared(stats, model), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    width = len(kept.columns)

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for rows in _blocks(it):
            x = np.array([r[width:] for r in rows], float)
            for r, s in zip(rows, held.value.score(x).tolist()):
                yield *r[:width], s

    return map_rows(stats.select(*keep, *SHARES), run, f"{schema}, score double")
