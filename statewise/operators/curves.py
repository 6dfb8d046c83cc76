"""Single series and designs: knee of a curve, serial correlation, covariates, inflation of variance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tails import chi2_tail


def knee_point(curve: DataFrame, sensitivity: float = 2.0, by: str = "series") -> DataFrame:
    """(series, x, y) of decreasing convex curves -> each series' first knee by the published Kneedle rule; none, no row.

    x and y are scaled to 0..1 and y is turned over; a local maximum of y - x
    is a knee once the difference falls under it less `sensitivity` mean steps
    before the next maximum.  A local minimum sets that bar to 0.
    """
    whole, order = W.partitionBy(by), W.partitionBy(by).orderBy("x")
    span = lambda c: F.try_divide(F.col(c) - F.min(c).over(whole), F.max(c).over(whole) - F.min(c).over(whole))
    unit = curve.na.drop(subset=["x", "y"]).select(by, "x", span("x").alias("u"), (1 - span("y")).alias("v"), F.count("*").over(whole).alias("n"))
    bent = unit.withColumn("d", F.col("v") - F.col("u"))
    before, after = F.lag("d").over(order), F.lead("d").over(order)
    # the mean step of x scaled to 0..1 is 1 / (n - 1)
    bar = F.when((F.col("d") >= before) & (F.col("d") >= after), F.struct("x", (F.col("d") - sensitivity / (F.col("n") - 1)).alias("bar")))
    low = F.when((F.col("d") <= before) & (F.col("d") <= after), F.struct("x", F.lit(0.0).alias("bar")))
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    turns = bent.withColumn("top", bar).withColumn("turn", F.coalesce(bar, low)).withColumn("next", after)
    state = turns.select(by, F.last("top", True).over(so_far)["x"].alias("knee"), F.last("turn", True).over(so_far)["bar"].alias("bar"), "next")
    return state.filter("knee is not null and next < bar").groupBy(by).agg(F.min("knee").alias("knee"))


def ljung_box(seq: DataFrame, lags: int = 10, x: str = "x", alpha: float = 0.05) -> DataFrame:
    """By subject and lag: autocorrelation, Ljung-Box statistic over all lags up to it, its p, and whether any p of the subject is under alpha.

    Series with fewer than 2 * lags + 5 steps are left out; one without
    variance has correlation 0.
    """
    own = W.partitionBy("subject")
    order = own.orderBy("t")
    centred = seq.select("subject", "t", (F.col(x) - F.avg(x).over(own)).alias("d"), F.count(x).over(own).alias("n")).filter(F.col("n") >= 2 * lags + 5)
    wide = centred.select("subject", "n", "d", *[F.lag("d", j).over(order).alias(f"l{j}") for j in range(1, lags + 1)])
    share = [F.coalesce(F.try_divide(F.sum(F.col("d") * F.col(f"l{j}")), F.sum(F.col("d") * F.col("d"))), F.lit(0.0)).alias(f"r{j}") for j in range(1, lags + 1)]
    per = wide.groupBy("subject", "n").agg(*share)
    long = per.select("subject", "n", F.posexplode(F.array(*[f"r{j}" for j in range(1, lags + 1)])).alias("lag", "r")).withColumn("lag", F.col("lag") + 1)
    running = F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag"))).over(own.orderBy("lag"))
    tested = long.withColumn("statistic", F.col("n") * (F.col("n") + 2) * running).withColumn("p_value", chi2_tail(F.col("statistic"), F.col("lag")))
    return tested.withColumn("serial", F.min("p_value").over(own) < alpha).select("subject", "lag", F.col("r").alias("autocorrelation"), "statistic", "p_value", "serial")


def residualise(panel: DataFrame, covariates: list[str], x: str = "x", key: str = "subject") -> DataFrame:
    """x without its series' least-squares fit on an intercept and the covariates (put "t" among them to detrend), and that as z-score.

    Cross products are summed by series; each task solves its batch of small
    systems.  A singular system takes the least-norm solution.  z is null where
    nothing varies.
    """
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]]
    p = len(terms)
    cross = [F.sum(a * b) for a in terms for b in terms] + [F.sum(a * F.col(x)) for a in terms]
    sums = panel.na.drop(subset=[x, *covariates]).groupBy(key).agg(F.array(*cross).alias("sums"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                s = np.stack(pdf["sums"].to_list())
                beta = np.einsum("nij,nj->ni", np.linalg.pinv(s[:, : p * p].reshape(-1, p, p), hermitian=True), s[:, p * p :])
                yield pd.DataFrame({key: pdf[key], "beta": list(beta)})

    kind = panel.schema[key].dataType.simpleString()
    fitted = panel.join(sums.mapInPandas(solve, f"`{key}` {kind}, beta array<double>"), key)
    fit = sum((F.col("beta")[i] * term for i, term in enumerate(terms)), F.lit(0.0))
    own = W.partitionBy(key)
    sd = F.stddev_samp("residual").over(own)
    return fitted.withColumn("residual", F.col(x) - fit).withColumn("z", F.when(sd > 1e-12, (F.col("residual") - F.avg("residual").over(own)) / sd)).drop("beta")


def variance_inflation(design: DataFrame, names: list[str]) -> DataFrame:
    """Inflation of each column's variance by the others, 1 / (1 - uncentred R^2): diagonal of the cross products times that of their inverse.

    One aggregation; only the square of the number of columns reaches the driver.
    """
    cols = [F.col(c).cast("double") for c in names]
    row = design.agg(*[F.sum(a * b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]).first()
    m = np.array([0.0 if v is None else v for v in row]).reshape(len(names), len(names))
    inverse = np.linalg.pinv(m, hermitian=True)
    return design.sparkSession.createDataFrame([(c, float(m[i, i] * inverse[i, i])) for i, c in enumerate(names)], "term string, vif double")
