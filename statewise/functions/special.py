"""Numeric functions that Spark lacks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 97.5 % point of the standard normal distribution.
Z975 = 1.959963984540054


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, absolute error under 1e-10.

    Up to |z| = 6 by the series z + z^3/3 + z^5/15 + ... times the density
    (all terms positive, 100 of them), beyond by the continued fraction of the
    tail.
    """
    a = F.abs(z)
    near = F.least(a, F.lit(6.0))
    start = F.struct(near.alias("term"), near.alias("total"))
    step = lambda s, k: F.struct((s["term"] * near * near / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * near * near / (2 * k + 1)).alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), start, step, lambda s: s["total"])
    density = F.exp(-near * near / 2) / F.sqrt(F.lit(2 * 3.141592653589793))
    far = F.greatest(a, F.lit(6.0))
    fraction = F.aggregate(F.sequence(F.lit(20), F.lit(1), F.lit(-1)), far, lambda f, k: far + k / f)
    tail = F.exp(-far * far / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) / fraction
    upper = F.when(a <= 6, 0.5 - density * total).otherwise(tail)
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def bin_half_even(x: Column, width: float) -> Column:
    """Nearest bin, halves to the even one."""
    return F.bround(x / width).cast("int")


def bin_floor(x: Column, width: float) -> Column:
    return F.floor(x / width).cast("int")


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are known; null where either does not vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
