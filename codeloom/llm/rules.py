"""Quality rules as a learned decision list.

Sequential covering: a rule is a conjunction of thresholds on document
statistics. It grows on two thirds of the labelled rows by the condition with
the highest information gain until it covers no document of the other label,
and is pruned on the last third from its end. Rows that it covers leave the set,
and the next rule is learned, until a rule no longer pays on the pruning set. The
list becomes one ordered conditional expression that Spark evaluates.

Without labelled rows, or with one label only, the list has no rule and keeps
what the base check keeps. Null statistics do not occur: null texts count as empty.
"""

from __future__ import annotations

import operator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import hashed_sample
from codeloom.llm.textstats import SHARES

#: Labelled rows that are learned from: those with the smallest hashes.
SAMPLE = 20_000
#: Thresholds tried for a statistic, conditions of a rule, rules of a list.
CUTS, CONDITIONS, RULES = 48, 4, 12
#: Share of the label among what a rule covers in the pruning rows, and the rows it must cover there.
PRECISION, COVERED = 0.8, 5


class Condition(NamedTuple):
    name: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"

    def column(self) -> Column:
        return (operator.gt if self.above else operator.le)(F.col(self.name), F.lit(self.threshold))

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return (operator.gt if self.above else operator.le)(x[self.name], self.threshold)


Rule = list[Condition]


def learn(x: dict[str, np.ndarray], y: np.ndarray) -> list[Rule]:
    """Rules under which a document is rejected, in order; ``y``: 1 is good. Row order doesn't matter to Spark: give hashed order."""
    bad, left, rules = y == 0, np.ones(len(y), bool), []
    grows = np.arange(len(y)) % 3 != 2
    while len(rules) < RULES:
        rule = _grown(x, bad, left & grows)
        rule = _pruned(rule, x, bad, left & ~grows)
        if not rule:
            break
        hit = covers(rule, x) & left
        test = hit & ~grows
        if test.sum() < COVERED or bad[test].mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule])


def _grown(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    rule, inside = [], rows.copy()
    while len(rule) < CONDITIONS and inside.any() and not bad[inside].all():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        if not p:
            break
        before, best, chosen = np.log2(p / (p + n)), 1e-9, None
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)[:-1]))
            # Counts above each cut in one sorted pass.
            order = np.argsort(v, kind="stable")
            upto = np.searchsorted(v[order], cuts, "right")
            bads = np.concatenate([[0], np.cumsum(b[order])])
            for above in (True, False):
                pos = (p - bads[upto]) if above else bads[upto]
                size = (len(v) - upto) if above else upto
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(pos / np.maximum(size, 1)) - before), 0)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, chosen = gain[i], Condition(name, above, float(cuts[i]))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= chosen.holds(x)
    return rule


def _pruned(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        hit = covers(r, x) & rows
        p, n = int((bad & hit).sum()), int((~bad & hit).sum())
        return (p - n) / (p + n) if p + n else -1.0

    options = [rule[:k] for k in range(len(rule), 0, -1)]
    return max(options, key=worth) if options else []


def fit(examples: DataFrame) -> list[Rule]:
    """Rules from rows with ``doc_id``, the statistics and ``y``."""
    rows = hashed_sample(examples.select("doc_id", "y", *SHARES), SAMPLE, "doc_id", "doc_id", "y").toPandas()
    if rows["y"].nunique() < 2:
        return []
    return learn({c: rows[c].to_numpy() for c in SHARES}, rows["y"].to_numpy())


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects: an ordered conditional, evaluated by Spark."""
    out = None
    for r in rules:
        condition = r[0].column()
        for c in r[1:]:
            condition = condition & c.column()
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
