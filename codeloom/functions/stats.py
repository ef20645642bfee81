"""Statistics over counts, as Column expressions on a single row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2)

#: Up to here the first term is summed exactly; beyond, Stirling's series is exact to a double.
DIRECT_TERMS = 1000


def _sum(sequence: Column, term) -> Column:
    return F.aggregate(sequence, F.lit(0.0), lambda acc, i: acc + term(i))


def _stirling_error(n: Column) -> Column:
    return 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * n * n * n * n * n)


def _ln_half_binomial(n: Column, m: Column) -> Column:
    """``ln(C(n, m) / 2**n)`` for ``0 <= m <= n / 2``."""
    n, m = n.cast("double"), m.cast("double")
    small = F.least(m, F.lit(float(DIRECT_TERMS))).cast("bigint")
    direct = F.when(m == 0, F.lit(0.0)).otherwise(
        _sum(F.sequence(F.lit(1), F.greatest(small, F.lit(1))), lambda i: F.log((n - m + i) / i))
    )
    rest = n - m
    skew = (n - 2 * m) / n
    deviance = n / 2 * ((1 - skew) * F.log1p(-skew) + (1 + skew) * F.log1p(skew))
    series = (
        _stirling_error(n)
        - _stirling_error(m)
        - _stirling_error(rest)
        - deviance
        - F.log(2 * math.pi * m * rest / n) / 2
    )
    return F.when(m <= DIRECT_TERMS, direct - n * LN2).otherwise(series)


def mcnemar_ln_p(b: Column, c: Column) -> Column:
    """Natural logarithm of the exact two-sided p-value of McNemar's test from the two discordant counts.

    ``min(1, 2 * P(X <= min(b, c)))`` for ``X ~ Binomial(b + c, 1/2)``. The terms
    are summed downwards from the largest one; those more than ``6 * sqrt(n)``
    below it are smaller than any double can show, so the work stays small even
    for billions of pairs. The logarithm holds where the value itself is below any double.
    """
    n, m = b + c, F.least(b, c)
    top = _ln_half_binomial(n, m)
    depth = F.least(m, (6 * F.sqrt(n)).cast("bigint") + 64)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        k = m - j + 1
        term = acc["term"] * k / (n - k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    tail = F.when(depth == 0, F.lit(1.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(depth, F.lit(1))), start, step)["total"]
    )
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(0.0), LN2 + top + F.log(tail)))


def mcnemar_p_value(b: Column, c: Column) -> Column:
    """Exact two-sided p-value of McNemar's test; zero if no double can show it."""
    return F.exp(mcnemar_ln_p(b, c))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k of one problem with ``c`` passing programs out of ``n``.

    ``1 - C(n - c, k) / C(n, k)``, as a product of ``k`` factors.
    """
    misses = F.lit(1.0)
    for j in range(k):
        misses = misses * (n - c - j) / F.nullif(n - j, F.lit(0))
    return F.when(c == 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(1 - misses)
