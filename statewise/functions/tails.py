"""Tail probabilities of the t and chi-square distributions and of rank correlations, as column expressions.

The continued fractions and series are folds over a sequence of term numbers,
evaluated from the last term inwards; the number of terms follows from the
degrees of freedom (it grows with their root).  Null, infinite or undefined
arguments, and degrees of freedom of 0 or less, give null.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 10


def _series(z: Column, terms: list[float]) -> Column:
    """Sum of terms[i] / z^(2 i + 1)."""
    inner = reduce(lambda total, c: total / (z * z) + c, reversed(terms), F.lit(0.0))
    return inner / z


def _product(z: Column) -> Column:
    return reduce(lambda p, i: p * (z + float(i)), range(1, _SHIFT), z)


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series at z + 10, taken back by the recurrence."""
    w = z + float(_SHIFT)
    far = (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + _series(w, [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188])
    return far - F.log(_product(z))


def _half_step(z: Column) -> Column:
    """Gamma(z + 1/2) / Gamma(z) for z > 0, without the loss of digits that a difference of two logarithms has."""
    w = z + float(_SHIFT)
    far = _series(w, [-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432])
    return F.sqrt(w) * F.exp(far) * _product(z) / _product(z + 0.5)


def _fold(steps: Column, start: Column, inward) -> Column:
    """inward(value, m) for m from `steps` down to 1."""
    return F.aggregate(F.sequence(steps, F.lit(1).cast("long"), F.lit(-1).cast("long")), start, lambda value, m: inward(value, m.cast("double")))


def _known(*args: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() & (F.abs(c) < math.inf) for c in args])


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) with df degrees of freedom."""
    t, n = t.cast("double"), df.cast("double")
    half = n / 2
    x, y = n / (n + t * t), t * t / (n + t * t)
    direct = x < (half + 1) / (half + 2.5)
    a, b, z = F.when(direct, half).otherwise(0.5), F.when(direct, 0.5).otherwise(half), F.when(direct, x).otherwise(y)
    even = lambda m: m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m))
    odd = lambda m: -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))
    steps = (60 + 4 * F.sqrt(half)).cast("long")
    inner = _fold(steps, F.lit(1.0), lambda value, m: 1 + even(m) / (1 + odd(m) / value))
    front = F.exp(-half * F.log1p(t * t / n)) * F.sqrt(y) * _half_step(half) / math.sqrt(math.pi)
    part = front / a / (1 + odd(F.lit(0.0)) / inner)
    return F.when(_known(t, n) & (n > 0), F.when(direct, part).otherwise(1 - part))


def chi2_tail(x: Column, df: Column) -> Column:
    """P(X >= x) of chi-square with df degrees of freedom: series below the mean, continued fraction above."""
    v, n = F.greatest(x.cast("double"), F.lit(0.0)) / 2, df.cast("double")
    a = n / 2
    steps = (200 + 12 * F.sqrt(a)).cast("long")
    front = F.when(v > 0, F.exp(a * F.log(v) - v - log_gamma(a))).otherwise(0.0)
    series = _fold(steps, F.lit(1.0), lambda value, m: 1 + value * v / (a + m)) / a
    below = _fold(steps, v + 2 * steps.cast("double") + 1 - a, lambda value, m: v + 2 * m - 1 - a + m * (a - m) / value)
    tail = F.when(v < a + 1, 1 - front * series).otherwise(front / below)
    return F.when(_known(x.cast("double"), n) & (n > 0), tail)


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a (rank) correlation of n pairs by its t form; 0 at |rho| = 1, null under three pairs."""
    t = rho * F.sqrt(F.try_divide(n - 2, 1 - rho * rho))
    return F.when(n > 2, F.when(F.abs(rho) >= 1, F.lit(0.0)).otherwise(t_two_sided(t, n - 2)))
